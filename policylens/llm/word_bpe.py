"""BPE with word ends: encoding by merge rounds over many words at a time in numpy, decoding by table.

The symbols of all new words of a block stand in one flat array.  A round looks up every adjacent pair that
is new by binary search over the sorted keys of all merges, takes the lowest rank of each word, merges
that pair wherever it stands in the word, from the left, and closes the gaps; words without a pair left are done.
Merging all places of a pair at once equals merging one at a time because a merge makes a symbol that only later merges
use, which is checked when the vocabulary is read.  A word met before is looked up.

Texts are normalised (NFC, lower case) and split into words first: by one pattern over its fixed character classes where
all characters are below U+0100, else by the tokenizers library's own normaliser and splitter, whose Unicode tables these are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.llm.bpe import byte_characters
from policylens.llm.common import column, give_back

#: Words, and their bytes, that a task remembers before it starts afresh.
CACHE, CACHE_BYTES = 200_000, 32 << 20
#: Words that are encoded at a time; texts whose ids leave the task together; characters of a text that is split in one go.
BLOCK, ROWS, LONG = 65_536, 256, 1 << 20

# What the vocabulary file says of normalising and splitting, and its suffix of last symbols.
NORMALISING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SUFFIX = "</w>"
# Letters (lower case), numerals and white space below U+0100.
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")



def _low(text: str) -> bool:
    """Whether all characters are below U+0100."""
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


_NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id, symbols of bytes inside and at the end of words, merges by sorted pair key, and added tokens."""

    tokens: list[str]
    inside: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    added: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file.  One that normalises, splits or merges in another way is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    parts = [{k: v for k, v in p.items() if k in ("type", "pattern", "behavior", "invert", "add_prefix_space", "use_regex")} for p in split["pretokenizers"]]
    words = {"type": "Split", "pattern": {"Regex": SPLITTING}, "behavior": "Removed", "invert": True}
    as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    own = all(not any(a[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for a in spec["added_tokens"])
    if (
        not (model["type"] == "BPE" and plain and own and model["end_of_word_suffix"] == SUFFIX)
        or spec["normalizer"]["normalizers"] != NORMALISING
        or parts != [words, as_bytes]
        or spec["decoder"] is not None
    ):
        raise ValueError(f"{path} is no word BPE of the kind read here")
    ids: dict[str, int] = model["vocab"]
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    tokens = [""] * (1 + max(*ids.values(), *added.values()))
    for token, i in {**ids, **added}.items():
        tokens[i] = token
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])]
    left, right, made = (np.array(x, np.int64) for x in zip(*merges))
    first_made = {int(c): r for r, c in reversed(list(enumerate(made)))}
    for rank, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if max(first_made.get(a, -1), first_made.get(b, -1)) >= rank:
            raise ValueError(f"{path}: merge {rank} uses a symbol that is made later")
    if len(first_made) != len(merges):
        raise ValueError(f"{path}: two merges make one symbol")
    keys = left * len(tokens) + right
    order = np.argsort(keys)
    characters = byte_characters()
    inside, last = (np.array([ids[c + end] for c in characters], np.int64) for end in ("", SUFFIX))
    return Vocabulary(tokens, inside, last, keys[order], order.astype(np.int32), made[order], added)


def merge(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of each word (not empty), as little-endian unsigned 32-bit integers."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = v.inside[raw]
    symbols[ends - 1] = v.last[raw[ends - 1]]
    word = np.repeat(np.arange(len(words)), sizes)
    out: list[bytes] = [b""] * len(words)

    def look_up(at: np.ndarray) -> None:
        """Rank and product of the pairs that start at some places; the last symbol of a word starts none."""
        wanted = symbols[at] * len(v.tokens) + symbols[np.minimum(at + 1, len(symbols) - 1)]
        found = np.minimum(np.searchsorted(v.keys, wanted), len(v.keys) - 1)
        fits = (v.keys[found] == wanted) & (at + 1 < len(symbols)) & (word[at] == word[np.minimum(at + 1, len(symbols) - 1)])
        rank[at] = np.where(fits, v.ranks[found], _NONE)
        product[at] = v.made[found]

    rank, product = np.empty(len(symbols), np.int32), np.empty(len(symbols), np.int64)
    if len(symbols):
        look_up(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        least = np.minimum.reduceat(rank, starts)
        size = np.diff(starts, append=len(symbols))
        done = least == _NONE
        if done.any():
            ids = symbols.astype("<u4")
            for s, n in zip(starts[done].tolist(), size[done].tolist(), strict=True):
                out[word[s]] = ids[s : s + n].tobytes()
            left = np.repeat(~done, size)
            symbols, word, rank, product = symbols[left], word[left], rank[left], product[left]
            least, size = least[~done], size[~done]
            if not len(symbols):
                break
        at = np.flatnonzero((rank == np.repeat(least, size)) & (rank != _NONE))
        if len(at) > 1 and (np.diff(at) == 1).any():
            # equal symbols in a row: every second place, counted from where the row starts
            row = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(at - np.repeat(at[row], np.diff(row, append=len(at)))) % 2 == 0]
        symbols[at] = product[at]
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        moved = at - np.arange(len(at))  # each merge before took one place
        symbols, word, rank, product = symbols[left], word[left], rank[left], product[left]
        look_up(np.concatenate([moved, np.maximum(moved - 1, 0)]))
    return out


class Encoder:
    """Texts to ids.  Words met before are remembered, within a bound."""

    def __init__(self, v: Vocabulary) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.v = v
        self.normaliser = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\\s+"), " "), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(SPLITTING), "removed", invert=True)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        self._forget()

    def _forget(self) -> None:
        self.known = {a: np.uint32(i).astype("<u4").tobytes() for a, i in self.v.added.items()}
        self.held = 0

    def words(self, text: str) -> Iterator[Sequence[str]]:
        """Words in order, some at a time; an added token, as it stands in the text, is one."""
        for part in self.added.split(text) if self.added else [text]:
            if part in self.v.added:
                yield [part]
            elif not _low(part):
                yield [w for w, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(part))]
            elif len(part) <= LONG:
                yield _WORDS.findall(part.lower())
            else:
                yield from batched((m.group() for m in _WORDS.finditer(part.lower())), BLOCK)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers in a row; none for null."""
        out: list[list[bytes]] = []
        waiting: list[tuple[int, Sequence[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            out.append([])
            for block in self.words(text or ""):
                waiting.append((k, block))
                size += len(block)
                if size >= BLOCK:
                    self._flush(waiting, out)
                    waiting, size = [], 0
        self._flush(waiting, out)
        return [b"".join(x) for x in out]

    def _flush(self, waiting: list[tuple[int, Sequence[str]]], out: list[list[bytes]]) -> None:
        new = list(set().union(*(block for _, block in waiting)).difference(self.known))
        if new:
            raw = [w.encode() for w in new]
            self.known.update(zip(new, merge(raw, self.v), strict=True))
            self.held += sum(map(len, raw))
        for k, block in waiting:
            out[k].append(b"".join(map(self.known.__getitem__, block)))
        if len(self.known) > CACHE or self.held > CACHE_BYTES:
            self._forget()


def decode(ids: bytes, tokens: list[str]) -> str:
    """The tokens of ids, each apart by a blank: the file names no decoder that would join them."""
    return " ".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with `token_ids` (binary, four bytes an id), `n_tokens` and `decoded` (string).

    A null text counts as empty: no ids, empty `decoded`.  Texts of any length are encoded whole, in blocks of words.
    An added token that a text holds is one id.  Every row is encoded by itself, so repeated rows and null ids need no
    rule; an empty table gives no rows.  Columns of `docs` named like a new one are replaced.
    """
    vocabulary = read_vocabulary(path)
    kept = [c for c in keep or docs.columns if c.lower() not in ("token_ids", "n_tokens", "decoded")]
    held = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = encoder.encode(t.as_py() for t in column(part, "text"))
                back = [decode(x, vocabulary.tokens) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "row"), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["row", "token_ids", "decoded"]
                )
        give_back()

    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, token_ids binary, decoded string")
    n_tokens = (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "token_ids", n_tokens, "decoded")
