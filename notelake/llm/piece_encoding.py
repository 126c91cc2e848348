"""SentencePiece merges without merging: a table of each prefix's last token, filled left to right, read backwards.

For each prefix of a unit of text there is one token with which its encoding ends. An automaton over the vocabulary
names the tokens that may end there; of these, the one that is compatible with the last token of the prefix before it
is right, where two tokens are compatible if merging their joint text gives just these two. Ids are then recovered from
the end. A unit is a run of word marks with what follows up to the next mark or line feed: no token crosses its ends, so
units met before are looked up. Characters outside the vocabulary are their UTF-8 bytes' ids, and nothing merges across.
Decoding starts from the ids of the whole document, the end id included, and knows nothing of the text.

Nulls: a null text is empty and has the end id only; null ids stay null. Repeated rows give repeated results. Texts of
any length are encoded whole, in time proportional to it. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept

MARK = "▁"
MEMO = 1 << 20
#: Bytes of ids and texts that a worker hands over together; one longer document is still whole.
HANDED = 4 << 20
RESULT = "doc_id long, ids array<int>, text string"


class PieceModel:
    """Vocabulary of a merge-type model with byte fallback, a leading mark and no other normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte, self.score, self.id, self.piece = [0] * 256, {}, {}, []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            self.piece.append(piece)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece], self.score[piece] = i, sp.get_score(i)
        if odd := [p for p in self.id if re.search(f"[^{MARK}]{MARK}", p)]:
            raise ValueError(f"pieces cross a word's mark: {odd[:5]}")
        self.end_id = sp.eos_id()
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.bytes_of = {i: b for b, i in enumerate(self.byte)}
        #: What each id says; one byte that no UTF-8 has for ids that say nothing.
        self.says = [bytes([self.bytes_of[i]]) if i in self.bytes_of else p.replace(MARK, " ").encode() if p in self.id else b"\xff" for i, p in enumerate(self.piece)]
        self.single = frozenset(p for p in self.id if len(p) == 1)
        self.halves: dict[str, tuple[str, str]] = {}
        self.edges: tuple[dict[str, list[str]], ...] = ({}, {})
        self.joint: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        # white space outside the vocabulary ends a unit as well
        breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id))
        none = re.escape(breaks)
        self.unit = re.compile(f"[{none}]|{MARK}*[^{MARK}{none}]+|{MARK}+" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """What merging in order of score, then of place, makes of a short text; tells how each piece came about."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        todo: list[tuple[float, int, int, str]] = []
        made: dict[int, tuple[str, str]] = {}

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (both := parts[i] + parts[j]) in self.score:
                heapq.heappush(todo, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while todo:
            _, i, j, both = heapq.heappop(todo)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            made[i] = (parts[i], parts[j])
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out = [p for p in parts if p is not None]
        if len(out) == 1 and len(text) > 1:
            self.halves[text] = made[0]
        return out

    def whole(self, token: str) -> bool:
        """Whether merging a token's own text gives the token."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.merged(token) == [token]
        return found

    def edge(self, token: str, side: int) -> list[str]:
        """The token and the parts at its last (1) or first (0) end, as it came about, from the whole to a character."""
        found = self.edges[side].get(token)
        if found is None:
            found, part = [token], token
            while len(part) > 1:
                if not self.whole(part):
                    found = []
                    break
                half = self.halves[part][side]
                if len(half) > 1 and part.strip(MARK) and self.score[half] <= self.score[part]:
                    raise ValueError(f"the piece {part} scores above its part {half}")
                part = half
                found.append(part)
            self.edges[side][token] = found
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joint text gives these two: no merge across the border comes first at any time.

        A part has a better score than the token it goes into, so the parts at the border come about in order of score.
        """
        key = (left, right)
        found = self.joint.get(key)
        if found is None:
            if len(self.joint) > MEMO:
                self.joint.clear()
            found = self.joint[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: str, right: str) -> bool:
        if left[-1] == MARK and right[-1] == MARK:  # pieces of marks share one score: place decides
            return self.merged(left + right) == [left, right]
        a, b, score = self.edge(left, 1), self.edge(right, 0), self.score
        if not a or not b:
            return False
        i, j = len(a) - 1, len(b) - 1
        while True:
            x = score[a[i - 1]] if i else -math.inf
            y = score[b[j - 1]] if j else -math.inf
            across = score.get(a[i] + b[j])
            if across is not None and across > x and across >= y:
                return False
            if not i and not j:
                return True
            if x >= y:
                i -= 1
            else:
                j -= 1

    def tokens(self, unit: str) -> list[str]:
        """The tokens of a unit; a character outside the vocabulary stands for itself."""
        if unit in self.id and self.whole(unit):
            return [unit]
        last: list[str | None] = [None] * len(unit)
        if not self.single.issuperset(unit):
            for at, c in enumerate(unit):
                if c not in self.single:
                    last[at] = c
        for end, token in self.automaton.iter(unit):
            if last[end] is not None:  # the table's entries are unique
                continue
            start = end + 1 - len(token)
            if start:
                before = last[start - 1]
                if before is None:  # no encoding ends there
                    continue
                right = self.compatible(before, token) if before in self.id else self.whole(token)
            else:
                right = self.whole(token)
            if right:
                last[end] = token
        out, at = [], len(unit)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def ids_of(self, token: str) -> list[int]:
        i = self.id.get(token)
        return [i] if i is not None else [self.byte[b] for b in token.encode()]

    def units(self, text: str) -> list[bytes]:
        """The ids of each unit of a text, as little-endian 32-bit numbers."""
        if not text:
            return []
        known, out = self.known, []
        for unit in self.unit.findall(MARK + text.replace(" ", MARK)):
            found = known.get(unit)
            if found is None:
                if len(known) > MEMO:
                    known.clear()
                found = known[unit] = np.array([i for token in self.tokens(unit) for i in self.ids_of(token)], dtype="<i4").tobytes()
            out.append(found)
        return out

    def spelled(self, ids: list[int]) -> str:
        """Pieces of ids as text, with blanks for marks. Bytes that aren't UTF-8 give a replacement character each."""
        try:
            return b"".join([self.says[i] for i in ids]).decode()
        except UnicodeDecodeError:
            return self._spelled(ids)

    def _spelled(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i >= 0 and i in self.shown():
                out.append(self.piece[i].replace(MARK, " "))
        return "".join(out)

    def shown(self) -> frozenset[int]:
        if not hasattr(self, "_shown"):
            self._shown = frozenset(self.id.values())
        return self._shown

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.units(text)), dtype="<i4").tolist() + [self.end_id]

    def decode(self, ids: list[int]) -> str:
        text = self.spelled(ids[:-1] if ids and ids[-1] == self.end_id else ids)
        return text[1:] if ids and self.piece[ids[0]].startswith(MARK) else text


def model_at(path: str) -> PieceModel:
    """The model at path, with the units that this worker's earlier tasks met."""
    return kept(f"pieces of {path}", lambda: PieceModel(path))


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """The ids of each of docs (doc_id, text), the end id last, and the text that these ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_at(model)
        docs, ids, texts, size = [], [], [], 0

        def handed() -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            numbers = pa.array(np.concatenate([np.array(x, dtype=np.int32) for x in ids]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(offsets, numbers), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = m.encode(text.as_py() or "")
                docs.append(doc)
                ids.append(own)
                texts.append(m.decode(own))
                size += 8 * len(own)
                if size > HANDED:
                    yield handed()
                    docs, ids, texts, size = [], [], [], 0
        if docs:
            yield handed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def encode_documents(docs: DataFrame, model: str, with_text: bool = False) -> DataFrame:
    """Number of ids, digests of ids and of the decoded text of each of docs (doc_id, text); with_text: ids and text too."""
    digests = [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")]
    return encoded(docs, model).select("doc_id", *digests, *(["ids", "text"] if with_text else []))


def op5_prefix_table_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the 32k piece model, and decoded again."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
