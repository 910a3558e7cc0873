"""Encoding and decoding with SentencePiece models of the merge type.

The pieces of a text are the only sequence in which each pair of neighbours stays two pieces when the merges are run again
on the pair alone.  So the encoder need not run merges over the text: it takes the longest piece at a position, as an
Aho-Corasick automaton finds it, checks it against its left neighbour, and goes back to a shorter one where that fails.  A
bit field holds the positions from which no way leads on; each is given up once only.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridspark.llm.batches import add_columns
from gridspark.llm.words import Memo

MARK = "▁"  # stands for a blank inside pieces
NEVER = float("-inf")


class PieceModel:
    """A model file whose texts are not normalised, read into plain tables."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece.Type
        if proto.trainer_spec.model_type != pb.TrainerSpec.ModelType.BPE:
            raise ValueError(f"{path}: not a model of the merge type")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{path}: only models that leave the text as it is and put a blank in front are supported")
        if not proto.trainer_spec.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError(f"{path}: only models with byte pieces and without user-defined or unused pieces are supported")
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.control: set[int] = set()
        self.starts_blank: set[int] = set()
        for i, p in enumerate(proto.pieces):
            text = b""
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                text = p.piece.replace(MARK, " ").encode()
                if p.piece.startswith(MARK):
                    self.starts_blank.add(i)
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], text = i, bytes([value])
            elif p.type == kinds.UNKNOWN:
                text = proto.trainer_spec.unk_surface.encode()
            else:
                self.control.add(i)
            self.surface.append(text)
        self.find = ahocorasick.Automaton()
        for piece in self.ids:
            self.find.add_word(piece, piece)
        self.find.make_automaton()
        if any(ch not in self.ids for piece in self.ids for ch in piece):
            raise ValueError(f"{path}: a piece holds a character that is no piece")
        self.stretch = self._stretches()
        self.pairs: Memo = Memo(lambda pair: self.merge(pair[0] + pair[1]) == list(pair), 500_000)
        self.words: Memo = Memo(self._word_bytes, 600_000)

    def _stretches(self) -> re.Pattern:
        """Cuts a text where no piece reaches over: before blanks and around lone characters.

        What can merge follows from the pairs of characters that stand side by side in some piece.
        """
        joints = {piece[k:k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        if any(j[1] == MARK and j[0] != MARK for j in joints):
            return re.compile("(?s).+")
        met = {c for j in joints for c in j}
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in met and c != 32)
        return re.compile(f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" + (f"|[{lone}]" if lone else ""))

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, leftmost first among equals."""
        parts, score = list(text), self.scores.get
        found = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while found:
            best = max(found)
            if best == NEVER:
                break
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def split(self, text: str) -> list[str]:
        """The pieces of a text by backtracking over longest matches.

        A match is the model's own string, so the pairs that are remembered share their pieces.
        """
        n, pairs = len(text), self.pairs
        starting: list[list[str]] = [[] for _ in text]
        for end, piece in self.find.iter(text):
            starting[end - len(piece) + 1].append(piece)  # shorter ones come first
        failed = None  # the bit field, made when the first position fails
        path: list[tuple[int, int]] = []
        out: list[str] = []
        left, at = "", 0
        here = starting[0] or [text[0]]  # a character without a piece stands alone
        choice = len(here)
        while True:
            while choice:
                choice -= 1
                piece = here[choice]
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if pairs[left, piece] if left else end < n or self.merge(piece) == [piece]:
                        out.append(piece)
                        if end == n:
                            return out
                        path.append((at, choice))
                        left, at = piece, end
                        here = starting[at] or [text[at]]
                        choice = len(here)
            if failed is None:
                failed = bytearray((n >> 3) + 1)
            failed[at >> 3] |= 1 << (at & 7)
            at, choice = path.pop()
            out.pop()
            here, left = starting[at] or [text[at]], out[-1] if out else ""

    def _word_bytes(self, word: str) -> bytes:
        """Ids of a stretch that its neighbours cannot merge with."""
        get, found = self.ids.get, array("I")
        for piece in self.split(word):
            i = get(piece)
            if i is None:
                found.extend([self.byte_ids[b] for b in piece.encode()])
            else:
                found.append(i)
        return found.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end as 32-bit integers in little-endian order; a null text counts as empty."""
        first, last = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()
        if not text:
            return first + last
        parts, words = self.stretch.findall(MARK + text.replace(" ", MARK)), self.words
        return b"".join([first, *[words[p] if len(p) < 64 else self._word_bytes(p) for p in parts], last])

    def decode(self, ids: bytes | None) -> str:
        """The text of such ids; bytes that form no character become U+FFFD one by one."""
        values = array("I")
        values.frombytes(ids or b"")
        control, surface = self.control, self.surface
        lead = next((k for k, i in enumerate(values) if i not in control), None)
        if lead is None:
            return ""
        runs: list[list[bytes]] = [[]]
        for i in values[lead:]:
            if i in control:
                runs.append([])  # bytes on its two sides do not form a character
            else:
                runs[-1].append(surface[i])
        out = "".join([b"".join(run).decode("utf-8", "one_by_one") for run in runs])
        return out[1:] if values[lead] in self.starts_blank else out


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of a file, kept by each worker process."""
    import codecs

    codecs.register_error("one_by_one", _one_by_one)
    return PieceModel(path)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids", carry: list[str] | None = None) -> DataFrame:
    """Add the ids of each whole text, begin and end included, as a binary column of little-endian 32-bit integers.

    Null and empty texts have the begin and end ids only.  Each row stands alone, so repeated rows and empty tables need no
    special case.  ``carry`` names the columns to keep (default: all); one named like ``ids`` is replaced.
    ``model_path`` must exist on every executor.
    """
    def make():
        model = load(model_path)
        return lambda texts: {ids: [model.encode(t) for t in texts]}

    return add_columns(df, [text], T.StructType([T.StructField(ids, T.BinaryType())]), make, carry)


def decode(df: DataFrame, model_path: str, ids: str = "piece_ids", text: str = "piece_text", carry: list[str] | None = None) -> DataFrame:
    """Add the text of such ids; null ids give an empty text."""
    def make():
        model = load(model_path)
        return lambda rows: {text: [model.decode(r) for r in rows]}

    return add_columns(df, [ids], T.StructType([T.StructField(text, T.StringType())]), make, carry)


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids", back: str = "piece_text",
                  carry: list[str] | None = None) -> DataFrame:
    """Add the ids as ``encode`` does and what ``decode`` makes of them, both by one Python worker a task.

    Two operators one after the other keep two workers a task, each with a model and remembered words of its own.
    """
    def make():
        model = load(model_path)

        def work(texts: list) -> dict[str, list]:
            made = [model.encode(t) for t in texts]
            return {ids: made, back: [model.decode(r) for r in made]}
        return work

    return add_columns(df, [text], T.StructType([T.StructField(ids, T.BinaryType()), T.StructField(back, T.StringType())]), make, carry)
