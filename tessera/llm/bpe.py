"""Byte-pair encoding by backtracking, and decoding by an offset table.

The encoder never replays merges.  An Aho-Corasick automaton over the vocabulary finds the longest
token at each byte; a chain of tokens is the exact result when every neighbouring pair is compatible,
that is, when merging the bytes of the pair would give the same two tokens.  The encoder extends a
chain by the longest token, tries shorter ones where the pair is incompatible, and steps back where
none is left; a bitmap of dead positions keeps that linear.

Defined cases: a null text counts as empty (no ids, empty decoded text); repeated rows are encoded one
by one; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from . import common, pretokens


def byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBpe:
    """Vocabulary, pair-compatibility table and offset table of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        name = byte_names()
        tok = Tokenizer.from_file(path)
        self.cut_text = tok.pre_tokenizer.pre_tokenize_str
        self.name = name
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        as_bytes = {i: bytes(name[c] for c in t) for t, i in vocab.items()}
        # A token's rank is the order in which merges make it; single bytes come first.
        singles = sorted(i for i, t in as_bytes.items() if len(t) == 1)
        self.ids = list(singles)  # rank -> id
        rank_of = {as_bytes[i]: r for r, i in enumerate(singles)}
        self.split = [(r, r) for r in range(len(singles))]
        self.joined: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = (bytes(name[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            rank = len(self.ids)
            pair = (rank_of[left], rank_of[right])
            self.joined[pair] = rank
            if left + right in rank_of:  # another way to a token that an earlier merge makes
                self.ids.append(vocab[merge[0] + merge[1]])
                self.split.append(pair)
                continue
            rank_of[left + right] = rank
            self.split.append(pair)
            self.ids.append(vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)])
        self.automaton = ahocorasick.Automaton()
        for t, r in rank_of.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.size = [0] * len(self.ids)
        self.shorter = [-1] * len(self.ids)
        for t, r in rank_of.items():
            self.size[r] = len(t)
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in rank_of:
                    self.shorter[r] = rank_of[t[:n]]
                    break
        self.known: dict[tuple[int, int], bool] = {}
        # Offset table: the bytes of id i are blob[offsets[i]:offsets[i + 1]].
        for content, i in self.special.items():
            as_bytes[i] = content.encode()
        sizes = np.zeros(max(as_bytes) + 2, np.int64)
        for i, t in as_bytes.items():
            sizes[i + 1] = len(t)
        self.offsets = np.cumsum(sizes)
        self.blob = np.frombuffer(b"".join(as_bytes.get(i, b"") for i in range(max(as_bytes) + 1)), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two neighbouring tokens would leave these two tokens.

        Undo merges from the latest to the earliest on the two sides of the border.  If at some
        step the tokens that touch there could merge earlier than the one undone last, they would
        have, and the pair cannot stand.
        """
        pair = (left, right)
        known = self.known.get(pair)
        if known is not None:
            return known
        limit = len(self.ids) + 1
        result = None
        while result is None:
            if self.joined.get((left, right), limit) < limit:
                result = False
            elif left > right:
                limit = left
                left = self.split[left][1]
                if left == limit:
                    result = True
            else:
                inner = self.split[right][0]
                if inner != right:
                    limit = right + 1
                    right = inner
                elif self.split[left][1] != left:
                    limit = left
                    left = self.split[left][1]
                else:
                    result = True
        if len(self.known) < 2_000_000:
            self.known[pair] = result
        return result

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        longest: list = [-1] * n
        size = self.size
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            at = end - length + 1
            if longest[at] < 0 or size[longest[at]] < length:
                longest[at] = rank
        chain: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = chain[-1] if chain else -1
            while token >= 0:
                end = at + size[token]
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                chain.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:  # no token can follow: this position is dead, try less before it
                alive[at] = 0
                chain.pop()
                at -= size[last]
                token = last
        return [self.ids[r] for r in chain]

    def pieces(self, spans: list[bytes]) -> list[list[int]]:
        return [self.encode(s) for s in spans]

    def whole(self, text: str) -> list[int]:
        """Ids of a text with any characters; strings of special tokens give their ids."""
        for content, i in self.special.items():
            if content in text:
                head, _, tail = text.partition(content)
                return [*self.whole(head), i, *self.whole(tail)]
        name = self.name
        return [i for p, _ in self.cut_text(text) for i in self.encode(bytes([name[c] for c in p]))] if text else []

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in order, end of each id's bytes)."""
        sizes = self.offsets[ids + np.uint32(1)] - self.offsets[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[at], ends


def backtracking_encoder(path: str) -> pretokens.Encoder:
    bpe = BacktrackingBpe(path)
    enc = pretokens.Encoder(bpe.pieces, bpe.whole)
    enc.bpe = bpe
    return enc


def encoded(docs, path: str):
    """doc_id, ids: the tokens of every text."""

    def run(batches):
        enc = pretokens.encoder(path, backtracking_encoder)
        for batch in batches:
            for lo, offs, ids in enc.rows(batch.column(1)):
                n = len(offs) - 1
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([batch.column(0).slice(lo, n), lists], ["doc_id", "ids"])

    text = common.id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return common.null_ids(text.mapInArrow(run, "doc_id long, ids array<int>"))


def as_text(joined: bytes) -> bytes:
    """UTF-8 of decoded bytes; bytes that are not UTF-8 become replacement characters."""
    try:
        joined.decode()
    except UnicodeDecodeError:
        return joined.decode(errors="replace").encode()
    return joined


def decoded(tokens, path: str):
    """doc_id, text: the inverse of ``encoded``."""

    def run(batches):
        bpe = pretokens.encoder(path, backtracking_encoder).bpe
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, lists = batch.column(0).slice(lo, 256), batch.column(1).slice(lo, 256)
                raw, ends = bpe.decode(lists.flatten().to_numpy().astype(np.uint32))
                raw, ends = raw.tobytes(), np.concatenate([[0], ends])
                cuts = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])].tolist()
                texts = [as_text(raw[a:b]).decode() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.record_batch([ids, pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.mapInArrow(run, "doc_id long, text string")


def round_trip(docs, path: str):
    """Digests of the ids and of the text decoded from them, without shipping either."""

    def run(batches):
        enc = pretokens.encoder(path, backtracking_encoder)
        for batch in batches:
            for lo, offs, ids in enc.rows(batch.column(1)):
                raw, ends = enc.bpe.decode(ids)
                raw, ends = raw.tobytes(), np.concatenate([[0], ends])
                packed = ids.astype("<u4").tobytes()
                cuts, at = ends[offs].tolist(), offs.tolist()
                n = len(at) - 1
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(np.diff(offs)),
                        pa.array([hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string()),
                        pa.array([hashlib.sha256(as_text(raw[a:b])).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    text = common.id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return common.null_ids(text.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op6_bpe_round_trip(spark, sf_dir):
    return round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
