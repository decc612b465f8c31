"""BPE encoding and decoding; unsplit text by tree concatenation.

A pre-token of over TREE_CHARS characters is halved until its parts fit, the halves are encoded, and they are joined in a binary
tree: a window of tokens around the join is encoded
again, and grows until its first token is the left side's and its last token the right side's. A
byte-pair encoding is the text's own exactly if every two neighbouring tokens are their own encoding; the
window's outer tokens are unchanged, so every pair lies in the left part, the window or the right part,
and the joined ids are those of the undivided pre-token.

Texts of up to PIECE_CHARS characters are encoded in their task, in batches, each distinct stretch once while it is remembered. A longer text is cut into
pieces that other tasks encode. A cut
before white space that follows a letter, digit or sign is safe: the pre-tokenizer's pattern never joins
across it and never looks back, so ids on both sides are those of the whole text. Where no such cut is
near, the stretch is split as the pre-tokenizer does, and the halves of a pre-token longer than a piece are pieces of their own,
joined where all of the text's ids meet. Ids are the library's whichever way a text takes.

Null texts are encoded as empty ones: no ids, and the empty string's hashes. Rows that repeat give equal
rows. Only doc_id and text are read. The library's own treatment of special tokens in a text is kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, trim

#: Characters of a pre-token that is encoded as a whole, and of a text that is encoded in one task.
TREE_CHARS, PIECE_CHARS = 32, 65_536
_BATCH_CHARS, _BATCH_ROWS = 1_000_000, 400
_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizer; the same without the pre-tokenizer's pattern; decimal strings of all ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
    from tokenizers import Tokenizer, pre_tokenizers

    whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    for t in (whole, plain):
        t.no_truncation()
        t.no_padding()
    plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return whole, plain, [str(i) for i in range(whole.get_vocab_size(with_added_tokens=True))]


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    """Bytes of each id, from the byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    whole = _library(path)[0]
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
    out = [b""] * whole.get_vocab_size(with_added_tokens=True)
    for token, i in whole.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(back[c] for c in token)
    return out


def encode_texts(texts: list[str], path: str, most: int | None = None) -> list[list[int]]:
    """Ids of whole texts, as the library gives them; those with unsplit runs of over ``most`` characters by way of the tree."""
    most = most or TREE_CHARS
    run = re.compile(rf"\S{{{most},}}|\s{{{most + 1},}}")  # no other text has a longer pre-token
    unsplit = [i for i, x in enumerate(texts) if len(x) > most and run.search(x)]
    if not unsplit:
        return _whole(texts, path)
    out = dict(zip(unsplit, (encode_unsplit(texts[i], path, most) for i in unsplit), strict=True))
    rest = [i for i in range(len(texts)) if i not in out]
    out |= zip(rest, _whole([texts[i] for i in rest], path), strict=True)
    return [out[i] for i in range(len(texts))]


def _whole(texts: list[str], path: str) -> list[list[int]]:
    return [e.ids for e in _library(path)[0].encode_batch_fast(texts, add_special_tokens=False)]


def encode_unsplit(text: str, path: str, most: int) -> list[int]:
    """Ids of a text by its pre-tokens, of which longer ones are encoded by halves and joined."""
    return _encode_pretokens(_pretokens(text, path), path, most)


def _encode_pretokens(tokens: list[str], path: str, most: int) -> list[int]:
    special = _special(path)
    parts = [[x] if x in special else _halves(x, most) for x in tokens]
    ids = iter(_library(path)[1].encode_batch_fast([x for own in parts for x in own], add_special_tokens=False))
    return [i for own in parts for i in join_tree([next(ids).ids for _ in own], path)]


def decode_ids(ids: list[list[int]], path: str) -> list[str]:
    return _library(path)[0].decode_batch(ids, skip_special_tokens=False)


def digests(ids: list[list[int]], path: str) -> tuple[list[int], list[str], list[str]]:
    """Length, the hash of the ids and the hash of the decoded text."""
    names = _library(path)[2].__getitem__
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return [len(x) for x in ids], [sha(",".join(map(names, x))) for x in ids], [sha(x) for x in decode_ids(ids, path)]


# -- words that repeat --------------------------------------------------------------------------------------

_STRETCH = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Stretches that a line feed between them keeps apart: one space, then no white space and no special token. Before the
#: space the line feed is a pre-token of its own, and no token of a stretch has a line feed in it.
_PLAIN = re.compile(r" [^\s<]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_MEMO = 300_000


class Memo:
    """Digests of texts from stretches that are each encoded and decoded once while they are remembered.

    A stretch begins with the white space that follows something else, a safe cut; texts with white space
    other than spaces and line feeds are encoded whole. Ids and decoded bytes of stretches join to the text's.
    """

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, str] = {}  # decimal ids
        self.odd: dict[str, str] = {}  # decoded text, of stretches where it differs
        self.warm: set[str] = set()  # stretches that came again

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        parts = [[x] if _OTHER_SPACE.search(x) else _STRETCH.findall(x) for x in texts]
        used = set().union(*parts)
        again = used & self.known.keys()
        new = used - again
        self.warm |= again
        if len(self.known) + len(new) > _MEMO:
            keep = self.warm if len(self.warm) <= _MEMO // 2 else again
            self.known = {x: self.known[x] for x in keep}
            self.odd = {x: y for x, y in self.odd.items() if x in self.known}
            self.warm = set()
        known, names = self.known, _library(self.path)[2].__getitem__
        plain = [x for x in new if len(x) <= TREE_CHARS and _PLAIN.fullmatch(x)]
        other = list(new.difference(plain))
        ids = encode_texts(other, self.path)
        for x, own, text in zip(other, ids, decode_ids(ids, self.path), strict=True):
            known[x] = ",".join(map(names, own))
            if x != text:
                self.odd[x] = text
        feed = encode_texts(["\n"], self.path)[0] if plain else []
        if len(feed) != 1:  # a vocabulary without a token for the line feed
            feed, groups = [], [[x] for x in plain]
        else:
            groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        mark = f",{feed[0]}," if feed else None
        ids = encode_texts(["\n".join(g) for g in groups], self.path)
        for g, own, text in zip(groups, ids, decode_ids(ids, self.path), strict=True):
            named = ",".join(map(names, own))
            for x, y, z in zip(g, named.split(mark) if mark else [named], text.split("\n"), strict=True):
                known[x] = y
                if x != z:
                    self.odd[x] = z
        counts, ids_sha, decoded_sha = [], [], []
        for text, own in zip(texts, parts, strict=True):
            named = ",".join(map(known.__getitem__, own))
            decoded = "".join(self.odd.get(x, x) for x in own) if self.odd else text
            counts.append(named.count(",") + 1 if own else 0)
            ids_sha.append(hashlib.sha256(named.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return counts, ids_sha, decoded_sha


# -- cutting ------------------------------------------------------------------------------------------------

_SAFE = re.compile(r"[0-9A-Za-z!-/:-@\[-`{-~](?=[ \n])")


def _last_safe(text: str, low: int, high: int) -> int:
    """The last place in (low, high] where white space follows a printable ASCII character, else -1."""
    at = high
    while at > low:
        at = max(text.rfind(" ", low + 1, at + 1), text.rfind("\n", low + 1, at + 1))
        if at < 0:
            return -1
        if "!" <= text[at - 1] <= "~":
            return at
        at -= 1
    return -1


def _halves(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    return _halves(text[: len(text) // 2], most) + _halves(text[len(text) // 2 :], most)


def pieces(text: str, path: str, most: int = PIECE_CHARS) -> list[tuple[list[str], bool, bool]]:
    """(parts, patterned, inner): parts to encode on their own; with the pattern or as single pre-tokens;
    inner: the piece goes on with the pre-token in which the piece before it ends."""
    out, at, special = [], 0, _special(path)
    while at < len(text):
        if len(text) - at <= most:
            out.append(([text[at:]], True, False))
            break
        cut = _last_safe(text, at, at + most)
        if cut > 0:
            out.append(([text[at:cut]], True, False))
            at = cut
            continue
        found = _SAFE.search(text, at + most)
        end = found.end() if found else len(text)
        group, size = [], 0
        for token in _pretokens(text[at:end], path):
            if size + len(token) > most and group:
                out.append((group, False, False))
                group, size = [], 0
            if len(token) > most and token not in special:
                out += [([half], False, i > 0) for i, half in enumerate(_halves(token, most))]
            else:
                group.append(token)
                size += len(token)
        if group:
            out.append((group, False, False))
        at = end
    return out


@lru_cache(maxsize=2)
def _special(path: str) -> frozenset[str]:
    return frozenset(t.content for t in _library(path)[0].get_added_tokens_decoder().values())


def _pretokens(text: str, path: str) -> list[str]:
    whole, special = _library(path)[0], sorted(_special(path), key=len, reverse=True)
    out = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]:
        if part in special:
            out.append(part)
        elif part:
            out += [part[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(part)]
    return out


def encode_piece(parts: list[str], patterned: bool, path: str) -> list[int]:
    if patterned:
        return [i for own in encode_texts(parts, path) for i in own]
    return _encode_pretokens(parts, path, TREE_CHARS)


# -- joining ------------------------------------------------------------------------------------------------


def join(left: list[int], right: list[int], path: str, window: int = 4) -> list[int]:
    """Ids of one pre-token from those of its two parts."""
    if not left or not right:
        return left + right
    plain, text = _library(path)[1], _token_bytes(path)
    continues = lambda b: 0x80 <= b[0] < 0xC0
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        while a and continues(text[left[a]]):  # a window begins and ends between characters
            a -= 1
        while b < len(right) and continues(text[right[b]]):
            b += 1
        seam = b"".join(text[i] for i in left[a:] + right[:b]).decode()
        new = plain.encode(seam, add_special_tokens=False).ids
        if (a == 0 or new[0] == left[a]) and (b == len(right) or new[-1] == right[b - 1]):
            return left[:a] + new + right[b:]
        window *= 2


def join_tree(parts: list[list[int]], path: str) -> list[int]:
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], path) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def concatenate(parts: list[tuple[list[int], bool]], path: str) -> list[int]:
    """Ids of a text from those of its pieces, in order, each with its ``inner``."""
    out: list[int] = []
    run: list[list[int]] = []
    for ids, inner in parts:
        if not inner and run:
            out += join_tree(run, path)
            run = []
        run.append(ids)
    return out + join_tree(run, path)


# -- on a DataFrame -----------------------------------------------------------------------------------------


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each row, encoded whole in its task; null texts have none, repeated rows equal ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode_texts(batch.column(1).to_pylist(), path), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids decode to the empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode_ids([x or [] for x in batch.column(1).to_pylist()], path), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encode(docs: DataFrame, path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row.

    Only texts of over ``piece_chars`` characters are shuffled, by pieces to be encoded and by text to be
    joined; equal (doc_id, text) rows among them are encoded once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= piece_chars)
    long = docs.where(F.length("text") > piece_chars).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))

    def encode_short(batches):
        trim()
        memo = Memo(path)
        for batch in batches:
            for first in range(0, batch.num_rows, _BATCH_ROWS):
                part = batch.slice(first, _BATCH_ROWS)
                texts, found = part.column(1).to_pylist(), ([], [], [])
                at = size = 0
                for i, x in enumerate([*texts, None]):
                    if x is None or size > _BATCH_CHARS:
                        for all_, own in zip(found, memo.digests(texts[at:i]), strict=True):
                            all_.extend(own)
                        at, size = i, 0
                    size += len(x or "")
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches):
        for batch in batches:
            for doc, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = hashlib.sha256(text.encode()).digest()[:16]
                for k, (parts, patterned, inner) in enumerate(pieces(text, path, piece_chars)):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "own": own, "copies": copies, "k": k, "parts": parts, "patterned": patterned, "inner": inner}], schema=cut_arrow)

    def encode_pieces(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.array(encode_piece(r["parts"], r["patterned"], path), np.uint32).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "own", "copies", "k", "inner")), pa.array(ids, pa.binary())], names=["doc_id", "own", "copies", "k", "inner", "ids"])

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        ids = concatenate([(np.frombuffer(x, np.uint32).tolist(), inner) for x, inner in zip(rows["ids"], rows["inner"], strict=True)], path)
        n, ids_sha, decoded_sha = digests([ids], path)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].tolist(), "copies": rows["copies"].iloc[:1].tolist(), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha})

    from pyspark.sql.pandas.types import to_arrow_type

    cut_arrow = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("own", pa.binary()), ("copies", pa.int64()), ("k", pa.int32()), ("parts", pa.list_(pa.string())), ("patterned", pa.bool_()), ("inner", pa.bool_())])
    cuts = long.mapInArrow(cut, f"doc_id {kind}, own binary, copies long, k int, parts array<string>, patterned boolean, inner boolean")
    encoded = cuts.repartition("doc_id", "own", "k").mapInArrow(encode_pieces, f"doc_id {kind}, own binary, copies long, k int, inner boolean, ids binary")
    joined = encoded.groupBy("doc_id", "own").applyInPandas(put_together, f"doc_id {kind}, copies long, {_DIGESTS}")
    again = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")
    return short.mapInArrow(encode_short, f"doc_id {kind}, {_DIGESTS}").unionByName(again)
