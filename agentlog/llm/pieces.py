"""SentencePiece encoding and decoding for models of merge type with byte fallback.

A word is encoded through a table of its prefixes. The encoding of each prefix has one last piece: of the pieces that end
there, found by an automaton, the one that the last piece of the shorter prefix stays apart from when the two are merged
on their own. Reading the table from the end gives the ids. Every prefix is decided once, so a text of any length takes
time in proportion to its length.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import fresh

SPACE = "▁"
WORDS_KEPT, LONGEST_KEPT, PAIRS_KEPT = 200_000, 40, 1_000_000


class Codec:
    """Encodes and decodes with one model, given as the bytes of its file.

    Words met lately and pairs of pieces tested are kept to save time, up to a number of each. Of a word only its ids are
    kept, as what is decoded from them is the word; one that decoded to something else would be worked out each time.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        special = {i for i in range(size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.id = {self.text[i]: i for i in range(size) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self._require()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if piece.strip(SPACE):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.add_word(SPACE, (self.id[SPACE], 1))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        # Words start at spaces. A newline without a piece of its own never merges, so words also end there.
        self.units = re.compile(r" +[^ ]*|[^ ]+" if "\n" in self.id else r"\n+| +[^ \n]*|[^ \n]+")

    def _require(self) -> None:
        """The properties of the model that cutting texts at spaces rests on."""
        if len(self.byte_id) != 256 or SPACE not in self.id:
            raise ValueError("a model with byte fallback and a space piece is needed")
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(2 * SPACE) and p.strip(SPACE)) for p in self.id):
            raise ValueError("a piece spans several words")
        runs = [self.score[p] for p in self.id if len(p) > 1 and not p.strip(SPACE)]
        if runs and max(runs) >= min(s for p, s in self.score.items() if len(p) > 1 and p.strip(SPACE)):
            raise ValueError("runs of spaces merge before words")

    def _merged(self, text: str) -> list[str]:
        """Symbols after all merges: the pair of the highest score first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (both := parts[a] + parts[b]) in self.score:
                heapq.heappush(heap, (-self.score[both], a, b, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b], right[a] = both, None, right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def _compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self._merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return known

    def _word(self, word: str) -> list[int]:
        """Ids of a text with a space at most in front."""
        last = [-1] * (len(word) + 1)  # -1: the start, or a character without a piece, which merges with nothing
        length = [1] * (len(word) + 1)
        pairs = self.pairs
        for end, (piece, n) in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                before = last[end - n]
                if before >= 0:
                    apart = pairs.get(before << 32 | piece)
                    if not (self._compatible(before, piece) if apart is None else apart):
                        continue
                last[end], length[end] = piece, n
        ids, at = [], len(word)
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids += [self.byte_id[b] for b in reversed(word[at - 1].encode())]
            at -= length[at]
        return ids[::-1]

    def _unit(self, unit: str) -> list[int]:
        """Spaces and the word behind them. Runs of spaces merge last, among the spaces that no word has taken."""
        spaces = len(unit) - len(word := unit.lstrip(" "))
        if not spaces:
            return self._word(word)
        ids = self._word(SPACE + word) if word else [self.id[SPACE]]
        if spaces > 1 and ids[0] != self.id[SPACE]:
            spaces -= 1
            return [self.id[p] for p in self._merged(SPACE * spaces)] + ids
        return [self.id[p] for p in self._merged(SPACE * spaces)] + ids[1:] if ids[0] == self.id[SPACE] else ids

    def _known(self, unit: str) -> tuple[bytes, str]:
        ids, decoded = self.old_words.get(unit), unit
        if ids is None:
            found = self._unit(unit)
            ids, decoded = array("i", found).tobytes(), self._spelled(found)
        if len(unit) <= LONGEST_KEPT and decoded == unit:
            if len(self.words) >= WORDS_KEPT:
                self.old_words, self.words = self.words, {}
            self.words[unit] = ids
        return ids, decoded

    def _spelled(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.id_byte.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.text[i].replace(SPACE, " "))
        return "".join(out) + raw.decode(errors="replace")

    def encoded(self, text: str) -> tuple[bytes, str]:
        """The ids as 32-bit integers, and the text decoded from them."""
        if not text:
            return b"", ""
        units = self.units.findall(" " + text.replace(SPACE, " "))
        parts = [(ids, u) if (ids := self.words.get(u)) else self._known(u) for u in units]
        return b"".join([p[0] for p in parts]), "".join([p[1] for p in parts])[1:]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode gives it: without the space put in front when encoding."""
        text = self._spelled(ids)
        return text[1:] if text.startswith(" ") else text


def encoder(df: DataFrame, model_path: str) -> Column:
    """A function column: text -> struct(ids array<int>, decoded string). The model file is read on the driver."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast({"bytes": f.read()})

    @F.arrow_udf("ids array<int>, decoded string")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = model.value  # a worker's own copy, which outlives the task
        codec = kept["codec"] = kept.get("codec") or Codec(kept["bytes"])
        for texts in batches:
            pairs = [codec.encoded(t.as_py() or "") for t in texts]
            ends = np.cumsum([0] + [len(ids) // 4 for ids, _ in pairs]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join([ids for ids, _ in pairs]), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.StructArray.from_arrays([ids, pa.array([d for _, d in pairs], pa.string())], ["ids", "decoded"])

    return encode


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The documents with the ids of each whole text and the text decoded from the ids; no shuffle.

    Ids are those of the sentencepiece library without begin or end ids and without sampling. NULL is an empty text,
    which has no ids. A space character of the vocabulary in the text is read as a space. Existing columns named as the
    two outputs are replaced.
    """
    pair, both = encoder(docs, model_path)(F.col(text)), fresh(docs, "_piece_pair")
    kept = [c for c in docs.columns if c.lower() not in (ids.lower(), decoded.lower())]
    return docs.withColumn(both, pair).select(
        *kept, F.col(both)["ids"].alias(ids), F.col(both)["decoded"].alias(decoded)
    )


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of an encoded row."""
    joined = F.concat_ws(",", F.col(ids).cast("array<string>"))
    return [
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
