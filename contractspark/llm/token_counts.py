"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are produced."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, slices, text_or_empty

#: Texts longer than this are searched piece by piece instead of as one list of words.
LONG_TEXT = 1 << 20
SUFFIX = "</w>"
#: A heap entry is rank << 40 | place.
PLACE = (1 << 40) - 1
#: Separators that Python takes for white space and the vocabulary's pattern does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(r"\S+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordCounter:
    """Counts tokens as the vocabulary's own library does, from the file's text.

    The file's form is checked: lower case, white space folded, words split by its pattern, byte-level
    pairs with a mark at the end of a word. Special strings count as one token each.
    """

    def __init__(self, vocabulary: str):
        file = json.loads(vocabulary)
        steps = [s["type"] for s in file["normalizer"]["normalizers"]]
        split, level = file["pre_tokenizer"]["pretokenizers"]
        model = file["model"]
        known = steps == ["NFC", "Replace", "Lowercase"] and split["invert"] and split["behavior"] == "Removed"
        if not (known and level["type"] == "ByteLevel" and model["end_of_word_suffix"] == SUFFIX):
            raise ValueError("not a lower-case word vocabulary with byte-level pairs and a word-end mark")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        letters = byte_letters()
        symbol = {c: b for b, c in enumerate(letters)} | {c + SUFFIX: 256 + b for b, c in enumerate(letters)}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            new = symbol.setdefault(left + right, 512 + rank)
            self.rank[symbol[left] << 20 | symbol[right]] = rank
            self.made.append(new)
        self.tokens = Memo(self._tokens)
        self.chunks = Memo(self._chunk, 350_000)

    def _tokens(self, word: str) -> int:
        """Initial symbols less merges: the pair of lowest rank, leftmost first, is merged until none is left."""
        find, made = self.rank.get, self.made
        symbols = list(word.encode())
        symbols[-1] += 256
        left = n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: The rank of the pair that begins at each place; an entry of the heap that differs is out of date.
        ranks = [find(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
        heap = [r << 40 | i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & PLACE, top >> 40
            if ranks[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            new = symbols[i] = made[r]
            left -= 1
            if k < n:
                ranks[j] = -1
                before[k] = i
                r = ranks[i] = find(new << 20 | symbols[k], -1)
                if r >= 0:
                    heappush(heap, r << 40 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                r = ranks[h] = find(symbols[h] << 20 | new, -1)
                if r >= 0:
                    heappush(heap, r << 40 | h)
        return left

    def _chunk(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma
        return sum(map(self.tokens.__getitem__, self.words.findall(text)))

    def _plain(self, text: str) -> int:
        """No word, letter composition or change of case reaches across white space, so chunks count by themselves."""
        if NOT_SPACE.search(text):  # str.split would part these, the pattern doesn't
            return self._chunk(text)
        if len(text) < LONG_TEXT:
            return sum(map(self.chunks.__getitem__, text.split()))
        return sum(self.chunks[m[0]] for m in CHUNK.finditer(text))

    def count(self, text: str) -> int:
        if self.special is None or not (found := self.special.findall(text)):
            return self._plain(text)
        return len(found) + sum(map(self._plain, self.special.split(text)))


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> WordCounter:
    return WordCounter(vocabulary)


def count_tokens(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``path`` is a vocabulary file on the driver; its text (a few MB whatever the data) is broadcast.
    Null and empty texts have no bytes and no tokens; a null id stays null; repeated rows stay
    repeated; an empty table gives none. Only the two named columns are read, so others may have any
    name. A task holds one slice of texts and a bounded memo of word counts.
    """
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    schema = f"{id_column} {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    counted = rows.mapInArrow(_count_batches(shared, id_column), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _count_batches(shared, id_column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        counter = _counter(shared.value)
        for batch in slices(batches):
            counts = pa.array([counter.count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), counts], [id_column, "n_bytes", "n_tokens"]
            )

    return run
