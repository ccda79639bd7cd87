"""Encoding and decoding with a merge-type SentencePiece vocabulary.

The merges are never simulated on whole texts. A text is cut at its spaces: no piece of such a
vocabulary has a space mark behind another character, so what lies between two spaces is encoded
alone. In each such unit an Aho-Corasick automaton finds the longest piece from every position; a
backtracking walk takes the longest piece that is compatible with the piece before it, and a bit
field remembers the positions from which the rest could not be covered. Two pieces are compatible
when undoing their merges, latest first, shows no merge across their border that would have come
earlier. The result is what the merges themselves give.

Within a unit, too, there are places that no piece spans, as between a word and the comma after it where no
piece has letters and commas. What lies between them is a run, and encoded alone as well.

Units and runs recur, so each task keeps bounded dictionaries of those that it has met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.llm.common import KEPT_IN_WORKER, begin_task, fields_without

SPACE = "▁"
#: Units in each of a task's two dictionaries (recent ones and those before), runs in one more, the longest that is kept, and
#: pairs of pieces whose check is kept. With some 200 bytes a unit or run and 100 a pair a task holds 200 MB at most.
KEPT_UNITS, KEPT_RUNS, KEPT_LENGTH, KEPT_PAIRS = 250_000, 400_000, 48, 200_000
#: Units that a worker keeps for its next task.
KEPT_COMMON = 40_000
_SPACED = re.compile(r"( +)([^ ]*)")


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model file: what tasks need, and no more than its vocabulary is long."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    #: id of the piece of each byte value
    byte_ids: tuple[int, ...]
    #: ids of pieces that stand for text, bytes excepted
    normal: tuple[int, ...]


@lru_cache(maxsize=4)
def vocabulary(model_path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    pieces = tuple(model.id_to_piece(i) for i in range(n))
    bytes_of = {int(pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
    if len(bytes_of) != 256:
        raise ValueError("the vocabulary has no piece for some byte")
    normal = tuple(i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return Vocabulary(pieces, tuple(model.get_score(i) for i in range(n)), tuple(bytes_of[b] for b in range(256)), normal)


def _runs(pieces: list[str]) -> re.Pattern:
    """Matches the runs of a unit one by one: characters that pieces put side by side, directly or by way of others, are of
    one kind, and no piece spans two kinds. A space mark, which stands in front, goes with any; a character of no kind is a run."""
    kind: dict[str, str] = {}

    def top(c: str) -> str:
        while (up := kind.setdefault(c, c)) != c:
            c = up
        return c

    for piece in pieces:
        if len(piece) > 1:
            of = [top(c) for c in piece if c != SPACE]
            for c in of[1:]:
                kind[top(c)] = top(of[0])
    kinds: dict[str, list[str]] = {}
    for c in kind:
        kinds.setdefault(top(c), []).append(c)
    classes = [f"[{''.join(map(re.escape, cs))}]+" for cs in sorted(kinds.values(), key=len, reverse=True)]
    return re.compile(f"{SPACE}?(?:{'|'.join(classes)})|." if classes else ".", re.DOTALL)


class _Runs(dict):
    """run -> its ids joined by commas; None where decoding them does not give the run back or they open with a lone space mark."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, run: str) -> str | None:
        e = self.encoder
        if e.known.issuperset(run):  # pieces in a row are the run itself
            ranks = e.known_run(run)
            made = ",".join([e.rank_number[r] for r in ranks]) if ranks[0] != e.lone else None
        else:
            ids = e.ids(run)
            made = ",".join([e.number[i] for i in ids]) if e.decode(ids) == run.replace(SPACE, " ") else None
        if len(run) <= KEPT_LENGTH:
            if len(self) >= KEPT_RUNS:
                self.clear()
            self[run] = made
        return made


class Encoder(dict):
    """unit -> its ids joined by commas, or, where decoding them does not give the unit back or they open
    with a lone space mark, (ids joined by commas, decoded text, whether they open with a lone space mark).

    The keys are units without the space in front.
    """

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        import ahocorasick

        self.vocab = vocab
        runs = {i for i in vocab.normal if len(vocab.pieces[i]) > 1 and set(vocab.pieces[i]) == {SPACE}}
        self.run_score = {len(vocab.pieces[i]): (vocab.scores[i], i) for i in runs}
        words = [i for i in vocab.normal if i not in runs]
        if any(SPACE in vocab.pieces[i][1:] for i in words):
            raise ValueError("the vocabulary has pieces with a space mark inside")
        if runs and max(vocab.scores[i] for i in runs) >= min(vocab.scores[i] for i in words if len(vocab.pieces[i]) > 1):
            raise ValueError("runs of spaces merge before other pieces in this vocabulary")
        # ranks in the order of the merges; single characters come before all of them
        words.sort(key=lambda i: (len(vocab.pieces[i]) > 1, -vocab.scores[i], i))
        self.id_of = words
        self.text = [vocab.pieces[i] for i in words]
        rank_of = {p: r for r, p in enumerate(self.text)}
        self.lone = rank_of.get(SPACE, -1)
        self.pair: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = []
        self.shorter = [-1] * len(words)
        whole = ahocorasick.Automaton()
        for rank, piece in enumerate(self.text):
            prefixes = [r for k in range(len(piece) - 1, 0, -1) if (r := rank_of.get(piece[:k], -1)) >= 0]
            self.shorter[rank] = prefixes[0] if prefixes else -1
            found = (rank, rank)
            for left in prefixes:
                right = rank_of.get(piece[len(self.text[left]) :], -1)
                if 0 <= right < rank and left < rank and self.compatible(left, right):
                    self.pair[left, right] = rank
                    found = (left, right)
                    break
            self.split.append(found)
            if len(piece) > 1 and found[0] != rank:  # pieces that no merges reach are left out
                whole.add_word(piece, (len(piece) - 1, rank))
        whole.add_word(SPACE * 2, (0, -1))  # in no unit: a vocabulary of characters alone has an automaton too
        whole.make_automaton()
        self.whole = whole
        reached = [len(p) == 1 or self.split[r][0] != r for r, p in enumerate(self.text)]
        for rank in range(len(words)):
            while (s := self.shorter[rank]) >= 0 and not reached[s]:
                self.shorter[rank] = self.shorter[s]
        self.sizes = [len(p) for p in self.text]
        self.single = {p: r for r, p in enumerate(self.text) if len(p) == 1}
        self.known = set(self.single)
        self.number = [str(i) for i in range(len(vocab.pieces))]
        self.rank_number = [self.number[i] for i in words]
        self.shown: list[str | None] = [p.replace(SPACE, " ") for p in vocab.pieces]
        for i in vocab.byte_ids:
            self.shown[i] = None
        self.cut = _runs(self.text).findall
        self.runs = _Runs(self)
        self.before: dict = {}
        self.checked: dict[tuple[int, int], bool] = {}
        self.run_memo: dict[int, list[int]] = {}

    def forget(self) -> None:
        """Gives back what was kept of the texts met so far, but for the units met first, which are the common
        ones; the automaton and the checked pairs stay."""
        common = dict(islice((self.before or self).items(), KEPT_COMMON))
        self.clear()
        self.update(common)
        self.before, self.run_memo = {}, {}
        self.runs.clear()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges would leave these two neighbours as they are."""
        limit = len(self.id_of) + 1
        pair, split = self.pair, self.split
        while True:
            if pair.get((left, right), limit) < limit:
                return False
            # undo the later of the two merges; a character cannot be undone
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    part = split[left][1]
                    if part != left:
                        limit, left = left, part
                        break
                else:
                    part = split[right][0]
                    if part != right:
                        limit, right = right + 1, part
                        break
                undo_left = not undo_left
            else:
                return True

    def known_run(self, text: str) -> list[int]:
        """Ranks of the pieces of a text whose characters are all in the vocabulary."""
        sizes, longest = self.sizes, [self.single[c] for c in text]
        for end, (back, rank) in self.whole.iter(text):  # ends rise, so the last from a start is the longest
            longest[end - back] = rank
        rank, n = longest[0], len(text)
        if sizes[rank] == n:
            return [rank]
        taken: list[int] = []
        failed = 0  # a bit for each position from which the rest cannot be covered
        at, before, checked = 0, -1, self.checked
        while True:
            while rank >= 0:
                end = at + sizes[rank]
                if not failed >> end & 1:
                    if before < 0:
                        break
                    fits = checked.get((before, rank))
                    if fits is None:
                        if len(checked) > KEPT_PAIRS:
                            checked.clear()
                        fits = checked[before, rank] = self.compatible(before, rank)
                    if fits:
                        break
                rank = self.shorter[rank]
            if rank >= 0:
                taken.append(rank)
                at, before = end, rank
                if at == n:
                    return taken
                rank = longest[at]
            else:
                failed |= 1 << at
                rank = taken.pop()
                at -= sizes[rank]
                before = taken[-1] if taken else -1

    def ids(self, unit: str) -> list[int]:
        """Ids of a unit without inner spaces; a leading space mark is part of it."""
        if self.known.issuperset(unit):
            return [self.id_of[r] for r in self.known_run(unit)] if unit else []
        out: list[int] = []
        start = 0
        known, id_of, byte_ids = self.known, self.id_of, self.vocab.byte_ids
        for at, char in enumerate(unit):
            if char not in known:
                if at > start:
                    out += [id_of[r] for r in self.known_run(unit[start:at])]
                out += [byte_ids[b] for b in char.encode()]
                start = at + 1
        if start < len(unit):
            out += [id_of[r] for r in self.known_run(unit[start:])]
        return out

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces that no letter joins: the best-scored and then leftmost merge, again and again."""
        if n not in self.run_memo:
            if len(self.run_memo) > 10_000:
                self.run_memo.clear()
            length, after, before, heap = [1] * n, [*range(1, n), -1], [*range(-1, n - 1)], []

            def offer(left: int) -> None:
                right = after[left]
                if right >= 0 and (joined := length[left] + length[right]) in self.run_score:
                    heappush(heap, (-self.run_score[joined][0], left, length[left], length[right]))

            for i in range(n - 1):
                offer(i)
            while heap:
                _, left, a, b = heappop(heap)
                right = after[left]
                if length[left] != a or right < 0 or length[right] != b:
                    continue
                length[left], length[right], after[left] = a + b, 0, after[right]
                if after[right] >= 0:
                    before[after[right]] = left
                if before[left] >= 0:
                    offer(before[left])
                offer(left)
            single = self.id_of[self.lone]
            self.run_memo[n] = [single if k == 1 else self.run_score[k][1] for k in length if k]
        return self.run_memo[n]

    def decode(self, ids: list[int]) -> str:
        """The text of ids within a unit, space marks as spaces, the leading one kept."""
        texts = [self.shown[i] for i in ids]
        if None not in texts:
            return "".join(texts)
        out, raw = [], bytearray()
        for i, text in zip(ids, texts, strict=True):
            if text is None:
                raw.append(self.vocab.byte_ids.index(i))
            else:
                if raw:
                    out.append(_utf8(raw))
                    raw = bytearray()
                out.append(text)
        return "".join([*out, _utf8(raw)])

    def entry(self, ids: list[int]) -> tuple[str, str, bool]:
        return ",".join([self.number[i] for i in ids]), self.decode(ids), ids[:1] == [self.id_of[self.lone]]

    def __missing__(self, word: str) -> str | tuple[str, str, bool]:
        made = self.before.get(word)
        if made is None:
            try:
                made = ",".join(map(self.runs.__getitem__, self.cut(SPACE + word)))
            except TypeError:  # some run is None
                made = self.entry(self.ids(SPACE + word))
                if not made[2] and made[1] == " " + word:
                    made = made[0]
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_UNITS:
                self.before = dict(self)
                self.clear()
            self[word] = made
        return made

    def both(self, text: str) -> tuple[str, str]:
        """The ids of a whole text, joined by commas, and the text that they decode to."""
        if not text:
            return "", ""
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            words = text.split(" ")
            made = [self[w] for w in words]
            try:
                return ",".join(made), text
            except TypeError:  # some unit is kept as a tuple
                pairs = [(" " + w, m) if m.__class__ is str else (m[1], m[0]) for w, m in zip(words, made, strict=True)]
                return ",".join([m for _, m in pairs]), "".join([t for t, _ in pairs])[1:]
        parts = self.parts(text)
        return ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])[1:]  # without the space put in front

    def parts(self, text: str) -> list[tuple[str, str, bool]]:
        """The entries of a text that is not empty, in order."""
        out = []
        for m in _SPACED.finditer(" " + text):
            n, word = len(m[1]), m[2]
            if not word:
                out.append(self.entry(self.spaces(n)))
                continue
            made = self[word]
            if isinstance(made, str):
                made = made, " " + word, False
            if n > 1 and made[2]:  # the space before the word joins the others
                out += [self.entry(self.spaces(n)), self.entry(self.ids(SPACE + word)[1:])]
            else:
                out += [self.entry(self.spaces(n - 1)), made] if n > 1 else [made]
        return out

    def encode(self, text: str) -> list[int]:
        return numbers(self.both(text)[0]).tolist()

    def decode_text(self, ids: list[int]) -> str:
        """The text of the ids of a whole text: as `decode`, without the space put in front."""
        text = self.decode(ids)
        return text[1:] if text[:1] == " " and ids and self.vocab.pieces[ids[0]][:1] == SPACE else text


def numbers(joined: str) -> np.ndarray:
    """Decimal ids joined by commas, as an array."""
    return np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32)


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that is no part of a character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + k]).decode())
                at += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_ENCODERS: dict[str, Encoder] = {}
KEPT_IN_WORKER.append(_ENCODERS.clear)


def _encoder(key: str, shared) -> Encoder:
    """One automaton for each Python worker and vocabulary; what is kept of texts belongs to a task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *arrays])))


def _with_columns(df: DataFrame, added: list[T.StructField], text_col: str, model_path: str, make) -> DataFrame:
    """``make`` gives the added columns from an encoder and the values of a batch."""
    key, shared = model_path, df.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    fields = fields_without(df, [a.name for a in added])
    schema, keep = T.StructType(fields + added), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(keeps=True)
        enc = _encoder(key, shared)
        try:
            for batch in batches:
                made = make(enc, batch.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *(a.name for a in added)])
        finally:
            enc.forget()  # the worker may serve other operators next

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col array<int>``: the ids of each whole text, without begin or end ids.

    A null or empty text has no ids. Other columns stay as they are; a column that already has
    the name of the result is replaced. Rows are independent: repeated rows give repeated rows.
    """

    def make(enc, texts):
        return [_lists([numbers(enc.both(t or "")[0]) for t in texts])]

    return _with_columns(df, [T.StructField(out_col, T.ArrayType(T.IntegerType()))], text_col, model_path, make)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds ``out_col string``: the text of each row's ids (null or no ids: an empty text)."""

    def make(enc, lists):
        return [pa.array([enc.decode_text(ids or []) for ids in lists], pa.string())]

    return _with_columns(df, [T.StructField(out_col, T.StringType())], ids_col, model_path, make)


def encode_and_decode(df: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds ``n_tokens long, ids_sha256, decoded_sha256`` (and ``ids``) for each whole text.

    The digests are those of the decimal ids joined by commas and of the text that decoding the
    ids gives. A null text counts as empty. One pass, no shuffle; memory is bounded by the batch
    and by the dictionary of units.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def make(enc, texts):
        n, ids_sha, text_sha, raw = [], [], [], []
        for text in texts:
            joined, decoded = enc.both(text or "")
            n.append(joined.count(",") + 1 if joined else 0)
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                raw.append(numbers(joined))
        out = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        return [*out, _lists(raw)] if with_ids else out

    return _with_columns(df, added, text_col, model_path, make)


def digest(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``documents``."""
    return encode_and_decode(df.select("doc_id", F.col("text")), model_path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
