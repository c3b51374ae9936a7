"""Exact encoding and decoding with a merge-type piece model, by backtracking.

Text is cut where no merge can cross: before a run of blanks that follows other characters, and around characters that no
longer piece contains. Within such a unit, an Aho-Corasick automaton over the pieces finds all matches; from each position
the longest is tried first. A piece may follow another only if merging their joined text anew, best rank first, gives
just these two; a position from which no piece led on is marked in a bit field and never tried again. When all
neighbours are compatible, the pieces are what merging the whole unit would give. Characters without a piece become bytes.

Defined results: null counts as empty; an empty text has the end id alone and decodes to an empty text; texts of any
length are encoded whole; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The blank that pieces use for a space.
BLANK = "▁"
#: Marks before which a word may be cut, where the pieces allow it.
MARKS = ".,;:!?|#$%&*()\"'-/"
#: Units whose encoding a worker keeps, twice over: when so many are new, those before the last time go. The pipeline's workers,
#: which hold other stages' tables too, keep KEPT; a job of its own may keep ALONE. Results don't depend on it.
KEPT, ALONE = 80_000, 240_000
UNKNOWN, NORMAL, BYTE = 2, 1, 6


class PieceModel:
    """The pieces of a model file, with encode(text) -> ids and decode(ids) -> text."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that keep text as it is, with one blank before it, are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.end = proto.trainer_spec.eos_id
        self.room = KEPT
        self.plain = set(self.ids.values())
        self.special = {i for i, p in enumerate(proto.pieces) if p.type not in (NORMAL, BYTE)}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        longer = [p for p in self.ids if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in longer):
            raise ValueError("a piece has a blank after another character; words can't be encoded apart")
        inside = set("".join(longer))
        self.known = {p for p in self.ids if len(p) == 1}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        # Marks that follow a letter in no piece: a word may be cut before them.
        after = {b for p in longer for a, b in zip(p, p[1:]) if a.isalpha()}
        marks = "".join(re.escape(c) for c in MARKS if c not in after)
        word = rf" *[^\W\d_]+(?:[^\w {alone}{marks}][^ {alone}]*|[\d_][^ {alone}]*)?"
        self.units = re.compile((f"[{alone}]|" if alone else "") + rf"{word}| *[^ {alone}]+| +").findall
        self.fits: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best rank first and leftmost among equals, until no pair makes a piece."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for j in range(len(parts) - 1):
                r = rank.get(parts[j] + parts[j + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, j
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = left, right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > self.room:
                self.fits.clear()
            known = self.fits[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def split(self, unit: str) -> list[str]:
        """The pieces and single unknown characters of a unit, whose spaces are blanks."""
        n = len(unit)
        ends: list[list[int]] = [[] for _ in range(n)]
        for last, size in self.automaton.iter(unit):
            ends[last - size + 1].append(last + 1)
        if not self.known.issuperset(unit):
            for at, char in enumerate(unit):
                if char not in self.known:
                    ends[at].insert(0, at + 1)
        fits, taken, tried, failed, at, k, left = self.fits.get, [], [], 0, 0, len(ends[0]) - 1, ""
        while at < n:
            options = ends[at]
            while k >= 0:
                to = options[k]
                piece = unit[at:to]
                if not (failed and failed >> to & 1):
                    fit = fits((left, piece))
                    if fit or fit is None and self.compatible(left, piece):
                        break
                k -= 1
            if k >= 0:
                taken.append(piece)
                tried.append(k)
                left, at = piece, to
                if at < n:
                    k = len(ends[at]) - 1
            else:
                failed |= 1 << at
                at, k = at - len(taken.pop()), tried.pop() - 1
                left = taken[-1] if taken else ""
        return taken

    def unit_ids(self, unit: str) -> list[int]:
        ids, split = self.ids, self.split(unit.replace(" ", BLANK))
        try:
            return [ids[p] for p in split]
        except KeyError:
            return [i for p in split for i in ([ids[p]] if p in ids else [self.byte[b] for b in p.encode()])]

    def _unit(self, unit: str) -> tuple[str, str]:
        """Ids joined by spaces, and their text."""
        got = self.old.get(unit)
        if got is None:
            ids = self.unit_ids(unit)
            text = self._text(ids)
            got = " ".join(map(str, ids)), unit if text == unit else text
        if len(self.kept) > self.room:
            self.old, self.kept = self.kept, {}
        if len(unit) <= 64:
            self.kept[unit] = got
        return got

    def _text(self, ids: list[int]) -> str:
        if self.plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids]).replace(BLANK, " ")
        raw = b"".join(bytes([self.of_byte[i]]) if i in self.of_byte else b"" if i in self.special else self.pieces[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(BLANK, " ")

    def both(self, text: str) -> tuple[str, str]:
        """The ids with the end id, joined by spaces, and the text that they decode to."""
        if not text:
            return str(self.end), ""
        new = self._unit
        got = [self.kept.get(u) or new(u) for u in self.units(" " + text.replace(BLANK, " "))]
        return " ".join([g[0] for g in got]) + f" {self.end}", "".join([g[1] for g in got])[1:]

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.both(text)[0].split(" ")))

    def decode(self, ids: list[int]) -> str:
        text = self._text(ids)
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's model for this file, read once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False, kept: int = KEPT) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens and, as digests are wanted or not, ids and decoded or their sha256. kept: units that a worker keeps."""
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches):
        m = model(path)
        m.room = kept
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1):
                ids, decoded = m.both(text.as_py() or "")
                n.append(ids.count(" ") + 1)
                first.append(hashlib.sha256(ids.encode()).hexdigest() if digests else list(map(int, ids.split(" "))))
                second.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
