"""SentencePiece BPE encoding with a merge-type prefix table, and decoding.

The encoding of a text's every prefix ends in one certain token. So a table holds the last token of each prefix: an
automaton finds the pieces that end at a position, and a piece is that token if it is compatible with the last token of
the prefix before it, that is, if the two, joined and encoded alone, come out as these two. Two neighbours that stay apart
alone stay apart in the text, because merges go by score and place only. The ids are then read from the end backwards.

No piece holds a white-space mark after another character, or a character without a piece of its own, or punctuation
after a letter (the model is searched for what may follow what); so texts are cut at such places, where no merge can
reach across, and each cut's encoding is remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.tables import table

codecs.register_error("sluice_each_byte", lambda error: ("\ufffd", error.start + 1))

SPACE = "▁"
REMEMBERED = 600_000  # cuts in a worker's memory, some 300 bytes each; then it starts afresh
LONGEST_REMEMBERED = 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """For models of type BPE with byte fallback, identity normalisation and a space put before the text."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(len(self.piece)) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        special = {i for i in range(len(self.piece)) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)}
        self.special = special - self.byte.keys()
        self.score = {p: lib.get_score(i) for i, p in enumerate(self.piece) if i not in special}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special}
        self.known = {p for p in self.id if len(p) == 1}
        if any(SPACE in p.lstrip(SPACE) or not self.known.issuperset(p) for p in self.id) or len(self.byte) != 256:
            raise ValueError("pieces of this model cross white space or hold characters without a piece")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merged(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        follows: dict[str, set[str]] = {}
        for p in self.id:
            for a, b in zip(p, p[1:], strict=False):
                follows.setdefault(a, set()).add(b)
        letters = {c for c in self.known if c.isalpha()}  # with all that follows one of them within a piece
        todo = list(letters)
        while todo:
            more = follows.get(todo.pop(), set()) - letters
            letters |= more
            todo += more
        inside, ends = re.escape("".join(sorted(letters))), "" if "\n" in self.known else "\n"
        self.cuts = re.compile(f"{SPACE}*[^{SPACE}{ends}{inside}]*[{inside}]+|{SPACE}*[^{SPACE}{ends}{inside}]+|{SPACE}+|\n").findall
        self.pair: dict[int, bool] = {}
        self.memory: dict[str, tuple[int, bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Merges by best score, then leftmost, until none is left; for the few characters of a token pair."""
        parts, score = list(text), self.score.get
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                found = score(parts[k] + parts[k + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, left: int, right: int) -> bool:
        a, b = self.piece[left], self.piece[right]
        return self.merged(a + b) == [a, b]

    def _table(self, cut: str) -> list[int]:
        """Ids of a cut of known characters."""
        last, pair = [-1] * (len(cut) + 1), self.pair
        for end, (size, token) in self.automaton.iter(cut):
            if last[end + 1] >= 0:
                continue
            before = end + 1 - size
            if before:
                key = last[before] << 20 | token
                fits = pair.get(key)
                if fits is None:
                    fits = pair[key] = self._compatible(last[before], token)
                if not fits:
                    continue
            last[end + 1] = token
        ids, at = [], len(cut)
        while at:
            ids.append(last[at])
            at -= len(self.piece[last[at]])
        return ids[::-1]

    def _cut_ids(self, cut: str) -> list[int]:
        if self.known.issuperset(cut):
            return self._table(cut)
        ids, run = [], ""
        for c in cut:
            if c in self.known:
                run += c
                continue
            ids += self._table(run) if run else []
            ids += [self.byte_id[b] for b in c.encode()]
            run = ""
        return ids + (self._table(run) if run else [])

    def encode_cuts(self, text: str) -> list[tuple[int, bytes, str]]:
        """Each cut's number of ids, ids as decimal digits joined by commas, and decoded text."""
        if not text:
            return []
        memory, cuts = self.memory, self.cuts(SPACE + text.replace(" ", SPACE))
        out = list(map(memory.get, cuts))
        if None in out:
            for k, cut in enumerate(cuts):
                if out[k] is not None:
                    continue
                ids = self._cut_ids(cut)
                out[k] = (len(ids), ",".join(map(str, ids)).encode(), self._surface(ids))
                if len(cut) <= LONGEST_REMEMBERED:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[cut] = out[k]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for _, ids, _ in self.encode_cuts(text) for x in ids.split(b",")]

    def _surface(self, ids: list[int]) -> str:
        """The ids' text, marks as spaces; byte pieces in a row are read as UTF-8, wrong bytes as U+FFFD each."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "sluice_each_byte"))
                run.clear()
            if i is not None and i not in self.special:
                out.append(self.piece[i])
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text without the space that encoding put before it."""
        first = next((i for i in ids if i not in self.special), None)
        text = self._surface(ids)
        return text[1:] if first is not None and first not in self.byte and self.piece[first].startswith(SPACE) else text


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _mapped(path: str | None, digest: Callable[[PieceModel, str], tuple], names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path or default_model())
        for b in batches:
            rows = [digest(model, t or "") for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded: the token ids of each whole text without begin and end ids, and their text.
    A null text counts as empty (no ids); one row per input row, in whatever order; an empty table gives none."""

    def digest(model: PieceModel, text: str) -> tuple:
        cuts = model.encode_cuts(text)
        return [int(x) for _, ids, _ in cuts for x in ids.split(b",")], "".join(s for _, _, s in cuts).removeprefix(" ")

    run = _mapped(path, digest, ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()])
    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; nulls and repeats as in encode()."""

    def digest(model: PieceModel, text: str) -> tuple:
        cuts = model.encode_cuts(text)
        ids = b",".join([ids for _, ids, _ in cuts])
        back = "".join([s for _, _, s in cuts]).removeprefix(" ")
        return sum(n for n, _, _ in cuts), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    run = _mapped(path, digest, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])
    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
