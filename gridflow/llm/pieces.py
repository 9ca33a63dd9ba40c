"""SentencePiece BPE with byte fallback: exact encoding by backtracking, and decoding.

A list of pieces is the encoding of a text exactly when each piece encodes to itself and
each adjacent pair encodes to itself, because a merge crosses one border only and merges on
both sides of other borders run in the same order without it. So the encoder takes the
longest piece at a position (Aho-Corasick matches), checks it against its left neighbour by
undoing the merges of the two, tries the next shorter piece where they are incompatible, and steps
back where none is left; a bit per position remembers where no encoding goes on.

A text is cut wherever no piece spans the cut (before white space marks, around line feeds
and other characters that are in no longer piece), so words are encoded on their own and
kept in bounded tables.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

MARK = "▁"
TABLE_WORDS = 150_000
TABLE_CHARS = 48
TABLE_PAIRS = 300_000
BATCH = 256
SPARK = {"array<int>": ArrayType(IntegerType()), "bigint": LongType(), "string": StringType()}
ARROW = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}


class Words(dict):
    """Ids of words as text, and the text they decode to, in two bounded tables; the older is dropped when the newer is full."""

    def __init__(self, make: Callable[[str], tuple[str, str]]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        got = self.older.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= TABLE_CHARS:
            if len(self) >= TABLE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


class PieceCodec:
    """Encoder and decoder for one SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        if len(self.byte) != 256 or sp.normalize(" a  b\n") != f"{MARK}{MARK}a{MARK}{MARK}b\n":
            raise ValueError("the model needs byte fallback, a leading mark and unchanged text")
        plain = [
            i for i in range(n)
            if i not in self.byte_of and i not in self.silent and i != self.unknown and not sp.is_unused(i)
        ]
        self.id_of = {self.piece[i]: i for i in plain}
        self.special = {*self.byte_of, *self.silent, self.unknown}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.plain = [self.piece[i].replace(MARK, " ") if self.piece[i] in self.id_of else None for i in range(n)]
        self.name = [str(i) for i in range(n)]
        inner = {(a, b) for p in self.score for a, b in zip(p, p[1:])}
        if any(b == MARK and a != MARK for a, b in inner) or any("\n" in pair for pair in inner):
            raise ValueError("pieces of the model span words or lines")
        self.cuts = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.pairs: dict[tuple[str, str], str] = {}
        self.words = Words(self.shown)
        #: The two pieces that are merged last into a piece, and when: merges of the best score come first.
        self.halves: dict[str, tuple[str, str]] = {}
        steps: list[tuple[str, str]] = []
        usable = []
        for p in self.score:
            if len(p) == 1 or self.merged(p, steps) == [p]:
                usable.append(p)
                if len(p) > 1:
                    self.halves[p] = steps[-1]
        when = {score: k for k, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: when[score] for p, score in self.score.items() if len(p) > 1}
        known = set(usable)
        #: The longest shorter piece (or the first character) that a piece starts with.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in known), p[0]) for p in usable if len(p) > 1}
        self.tree = ahocorasick.Automaton()
        for p in usable:
            self.tree.add_word(p, p)
        self.tree.make_automaton()

    def forget(self) -> None:
        """Give back the memory of all known words; pairs of pieces, which are far fewer, are kept."""
        self.words.clear()
        self.words.older = {}

    def merged(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Merge a short text piece by piece: best score first, then leftmost. `steps` gets the merges made."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (score := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-score, i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def fitting(self, left: str, piece: str) -> str:
        """The first of a piece and the shorter ones it starts with that stays beside `left` when both are merged anew."""
        known = self.pairs.get((left, piece))
        if known is None:
            known = piece
            while known and not self.parted(left, known):
                known = self.shorter.get(known, "")
            if len(self.pairs) >= TABLE_PAIRS:
                self.pairs.clear()
            self.pairs[left, piece] = known
        return known

    def parted(self, left: str, right: str) -> bool:
        """Does merging the two pieces anew give the same two pieces?

        The merges of both are undone, the latest first: none across their border may come before one undone.

        Of merges of equal score the left one is made first, so one across the border comes
        before that of the right piece, and after that of the left one.
        """
        rank, halves, limit = self.rank, self.halves, len(self.score)
        a, b = rank.get(left, -1), rank.get(right, -1)
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            if a > b:
                left, limit = halves[left][1], a
                a = rank.get(left, -1)
            elif b < 0:
                return True
            else:
                right, limit = halves[right][0], b + 1
                b = rank.get(right, -1)

    def longest(self, word: str, at: int) -> str:
        """The longest piece at a position; one character where there is none."""
        for end, piece in self.tree.iter_long(word, at):
            return piece if end - len(piece) + 1 == at else word[at]
        return word[at]

    def split(self, word: str) -> list[str]:
        """Pieces (or single characters without a piece) of a word, by backtracking."""
        matches = list(self.tree.iter_long(word))
        parts = [piece for _, piece in matches]
        n, pairs, shorter, longest = len(word), self.pairs, self.shorter, self.longest
        whole = sum(map(len, parts)) == n
        fit = list(map(pairs.get, zip(parts, parts[1:]))) if whole else []
        if whole and fit == parts[1:]:
            return parts  # the longest pieces, one after another, fit
        # longest pieces that are known already, by the position they start at
        starts = {end - len(piece) + 1: piece for end, piece in matches}
        failed = 0  # a bit for each position from which no encoding goes on
        kept = next(k for k, f in enumerate(fit, 1) if f != parts[k]) if whole else 0
        at, last = (matches[kept - 1][0] + 1, parts[kept - 1]) if kept else (0, "")
        del parts[kept:]
        part = (starts.get(at) or longest(word, at)) if word else ""
        while at < n:
            while part:
                if last:
                    first = pairs.get((last, part))
                    part = self.fitting(last, part) if first is None else first
                if not (failed and part and failed >> at + len(part) & 1):
                    break
                part = shorter.get(part, "")
            if part:
                parts.append(part)
                at += len(part)
                last = part
                if at < n:
                    part = starts.get(at) or longest(word, at)
            else:  # no piece goes on from here: mark it and shorten the piece before
                failed |= 1 << at
                part = parts.pop()
                at -= len(part)
                last = parts[-1] if parts else ""
                part = shorter.get(part, "")
        return parts

    def ids(self, parts: list[str]) -> list[int]:
        try:
            return [self.id_of[p] for p in parts]
        except KeyError:  # a character without a piece: its bytes
            return [i for p in parts for i in ((self.id_of[p],) if p in self.id_of else [self.byte[b] for b in p.encode()])]

    def shown(self, word: str) -> tuple[str, str]:
        """The ids of a word joined by commas, and the text that these ids decode to."""
        ids = self.ids(self.split(word))
        return ",".join([self.name[i] for i in ids]), self.text_of(ids)

    def cut(self, text: str) -> list[str]:
        return self.cuts.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        shown = ",".join([ids for ids, _ in map(self.words.__getitem__, self.cut(text))])
        return list(map(int, shown.split(","))) if shown else []

    def text_of(self, ids: list[int]) -> str:
        """Text of ids inside a text; bytes that are no UTF-8 become one U+FFFD each."""
        try:
            return "".join([self.plain[i] for i in ids])
        except TypeError:  # some ids are no plain pieces
            pass
        out: list[str] = []
        at = 0
        while at < len(ids):
            if ids[at] in self.byte_of:
                end = at
                while end < len(ids) and ids[end] in self.byte_of:
                    end += 1
                out.append(lenient(bytes(self.byte_of[i] for i in ids[at:end])))
                at = end
                continue
            if ids[at] == self.unknown:
                out.append(" ⁇ ")
            elif ids[at] not in self.silent:
                out.append(self.piece[ids[at]].replace(MARK, " "))
            at += 1
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; the mark that encoding puts first is taken off."""
        return self.unmarked(self.text_of(ids), ids)

    def unmarked(self, text: str, ids: Iterable[int]) -> str:
        """The text of ids without the mark of their first piece that shows."""
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.piece[first].startswith(MARK) else text


def lenient(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def codec(model_file: str) -> PieceCodec:
    """The codec of a model, built once in a Python worker.

    Kept at the interpreter, as this module comes anew with every task.
    """
    codecs = sys.__dict__.setdefault("_gridflow_codecs", {})
    if model_file not in codecs:
        codecs[model_file] = PieceCodec(model_file)
    return codecs[model_file]


def per_text(df: DataFrame, text_col: str, new: dict[str, str], make: Callable[[], Callable]) -> DataFrame:
    """Put the columns `new` (name: type) in place of a text column, in small Arrow batches.

    `make` gives, inside a task, the function from a text (null: empty) to the new values.
    Other columns stay, but for those named as a new one, which it replaces.
    """
    others = [f for f in df.schema.fields if f.name != text_col and f.name not in new]
    schema = StructType([*others, *[StructField(n, SPARK[t]) for n, t in new.items()]])
    kinds = [ARROW[t] for t in new.values()]
    names = [f.name for f in schema.fields]
    width = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    rows = [one(t.as_py() or "") for t in part.column(width)]
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], names=names)
        finally:  # the worker goes on to other tasks
            for c in sys.__dict__.get("_gridflow_codecs", {}).values():
                c.forget()

    return df.select(*[F.col(f"`{f.name}`") for f in others], F.col(text_col)).mapInArrow(run, schema)


def encode_texts(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """`df` with `token_ids` in place of the text column. Null text is empty and has no ids."""

    def make():
        c = codec(model_file)
        return lambda text: (c.encode(text),)

    return per_text(df, text_col, {"token_ids": "array<int>"}, make)


def decode_ids(df: DataFrame, model_file: str, ids_col: str = "token_ids") -> DataFrame:
    """`df` with `decoded` text in place of the ids column. Null ids give the empty text."""

    def make():
        c = codec(model_file)
        return lambda ids: (c.decode(list(ids)),)

    return per_text(df, ids_col, {"decoded": "string"}, make)


def digest_texts(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """Encode and decode every text and keep only counts and digests of both.

    Columns n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 take the
    place of the text column. A word's ids come from its pieces, its decoded text from its
    ids; the joined results equal encode and decode of the whole text, as no piece and no run
    of bytes spans two words. Null and empty texts have no ids; very long texts are whole.
    """

    def make():
        c = codec(model_file)

        def one(text: str) -> tuple:
            found = list(map(c.words.__getitem__, c.cut(text)))
            ids = ",".join([i for i, _ in found])
            decoded = c.unmarked("".join([t for _, t in found]), map(int, found[0][0].split(","))) if found else ""
            n = ids.count(",") + 1 if ids else 0
            return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return one

    return per_text(df, text_col, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, make)
