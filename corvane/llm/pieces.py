"""Exact merge-type piece encoding by backtracking, and decoding.

An encoding of merge type is the one sequence of pieces in which every two
neighbours stay apart when their joined text is merged anew.  The encoder walks
the text with the longest pieces that start at each place (Aho-Corasick), takes
the longest that fits its left neighbour, falls back to shorter prefixes, and
where none fits marks the place in a bitfield of failed places and takes the last
piece back.  No merge queue over the text is kept.

Texts are cut where no piece can cross: before a run of spaces, and around
characters that occur in no longer piece.  Encodings of short words are kept in a
two-generation cache of fixed size in each Python worker.

Defined results: a null or empty text is the end id alone and decodes to the
empty text; repeated rows are encoded alike, and rows without an id as others; an empty
table gives no rows; other columns are not carried, whatever their names.  Of equal
scores the leftmost pair merges first.  A task holds one whole text and its ids at a
time, whatever the text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .tables import read

SPACE = "▁"
ENCODED = tx.arrow_schema(doc_id=pa.int64(), n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())


class PieceModel:
    """Vocabulary of a piece model file with identity normalisation, a dummy prefix and byte fallback."""

    CACHED, LONGEST = 300_000, 40

    def __init__(self, path: str):
        import sentencepiece

        # the library reads the vocabulary; it does not encode or decode
        vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = "Ａ ﬁ  é²\u00a0x\u3000y"  # changed by any other normalisation than none
        if vocabulary.decode(vocabulary.encode(odd)) != odd or vocabulary.encode("a", out_type=str)[:1] not in (["▁a"], ["▁"]):
            raise ValueError("only models without normalisation and with a space put before the text are known")
        n = vocabulary.get_piece_size()
        self.end_id = vocabulary.eos_id()
        names = [vocabulary.id_to_piece(i) for i in range(n)]
        self.byte_ids: dict[int, int] = {}
        self.decoded: list[bytes] = []
        self.ids: dict[str, int] = {}
        for i, name in enumerate(names):
            if vocabulary.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.decoded.append(bytes([int(name[3:5], 16)]))
            elif vocabulary.is_control(i) or vocabulary.is_unused(i) or vocabulary.is_unknown(i):
                self.decoded.append(b"")
            else:
                self.ids[name] = i
                self.decoded.append(name.replace(SPACE, " ").encode())
        self.names = names
        self.score = {name: vocabulary.get_score(i) for name, i in self.ids.items()}
        self.pair_fits: dict[tuple[int, int], bool] = {}
        # pieces that merging never makes of their own text are never part of an encoding
        usable = {name: i for name, i in self.ids.items() if self.merge(name) == [name]}
        self.single = {name for name in usable if len(name) == 1}
        self.automaton = ahocorasick.Automaton()
        for name, i in usable.items():
            self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.length = [len(name) for name in names]
        self.shorter: dict[int, int] = {}
        for name, i in usable.items():
            for k in range(len(name) - 1, 0, -1):
                if name[:k] in usable:
                    self.shorter[i] = usable[name[:k]]
                    break
        joined = {c for name in usable if len(name) > 1 for c in name}
        self.barriers = {c for c in "\n\t\r" if c not in joined}
        runs_only = all(SPACE not in name[1:] or not name.strip(SPACE) for name in usable)
        if not runs_only:
            raise ValueError("a piece holds a space after another character; texts can't be cut before spaces")
        self.splitter = re.compile(f"[{''.join(self.barriers)}]|{SPACE}*[^{SPACE}{''.join(self.barriers)}]+|{SPACE}+")
        self.words = self._cache()

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by repeated merging of the best neighbours, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when their joined text is merged anew."""
        found = self.pair_fits.get((left, right))
        if found is None:
            a, b = self.names[left], self.names[right]
            found = self.merge(a + b) == [a, b]
            if len(self.pair_fits) >= self.CACHED:
                self.pair_fits.clear()
            self.pair_fits[left, right] = found
        return found

    def backtrack(self, text: str) -> list[int]:
        """Encode a run of characters that all are pieces themselves."""
        n = len(text)
        longest = [0] * n
        for end, (i, size) in self.automaton.iter(text):
            longest[end - size + 1] = i  # later ends are longer
        failed = bytearray((n >> 3) + 1)
        length, shorter = self.length, self.shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while True:
                end = at + length[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self.fits(last, token)):
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    break
                if token in shorter:
                    token = shorter[token]
                    continue
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= length[token]
                break
        return out

    def segment(self, text: str) -> list[int]:
        """Encode a text that pieces don't reach beyond; unknown characters become bytes."""
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.single:
                if k > start:
                    out += self.backtrack(text[start:k])
                out += [self.byte_ids[b] for b in c.encode()]
                start = k + 1
        return out + self.backtrack(text[start:]) if start < len(text) else out

    def _cache(self):
        model = self

        class Words(dict):
            """Of each segment: its ids as text, their number, and what they decode to."""

            old: dict = {}

            def __missing__(self, segment: str) -> tuple[str, int, bytes]:
                found = self.old.get(segment)
                if found is None:
                    ids = model.segment(segment)
                    found = (" ".join(map(str, ids)), len(ids), b"".join([model.decoded[i] for i in ids]))
                if len(segment) <= model.LONGEST:
                    if len(self) >= model.CACHED:
                        self.old = dict(self)
                        self.clear()
                    self[segment] = found
                return found

        return Words()

    def encode(self, text: str) -> tuple[str, int, bytes]:
        """Ids joined by spaces (the end id last), their number, and the decoded bytes."""
        if not text:
            return str(self.end_id), 1, b""
        escaped = SPACE + text.replace(" ", SPACE)
        parts = list(map(self.words.__getitem__, self.splitter.findall(escaped)))
        ids = " ".join([p[0] for p in parts])
        decoded = b"".join([p[2] for p in parts])
        return f"{ids} {self.end_id}", sum([p[1] for p in parts]) + 1, decoded[1:] if decoded[:1] == b" " else decoded


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each Python worker and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the decoded text, a row for each input row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for one in batches:
            rows: dict[str, list] = {f.name: [] for f in ENCODED}
            for doc, text in zip(one["doc_id"], one["text"], strict=True):
                ids, n, decoded = own.encode(text.as_py() or "")
                rows["doc_id"].append(doc.as_py())
                rows["n_tokens"].append(n)
                rows["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield tx.batch(rows, ENCODED)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, tx.spark_schema(ENCODED))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
