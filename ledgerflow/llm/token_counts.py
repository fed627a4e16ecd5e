"""Token counts of whole texts, huge ones included, by a library tokenizer.

A huge text is encoded in overlapping chunks with offsets. Two neighbours are spliced at a common boundary that is
proven stable: both encodings have a token end and a token start there, white space lies between, and the tokens on
either side are the same in both. Where the overlap holds none, it is widened and the chunks are encoded again; at
worst the two chunks become one.

Other texts are cut at ASCII white space, which is such a boundary in any context for a tokenizer that drops white space
(see ``cuts_at_spaces``), and each distinct unit is encoded once per worker. A tokenizer that doesn't is given whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Texts over so many characters are huge: encoded in chunks of this size that overlap by OVERLAP.
CHUNK, OVERLAP = 1 << 15, 256
#: Tokens that must agree on each side of a boundary within the overlap.
AGREE = 4
#: Units remembered by a worker before they are forgotten.
UNITS_KEPT = 400_000


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file says that white space separates units that never influence each other.

    That holds for the normalizers NFC, white space runs to one space, and lower case (none looks across a space), a
    pre-tokenizer that keeps only matches of a pattern without white space, and no added token with white space in it.
    """
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for s in steps)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and " " not in first["pattern"].get("Regex", " ")
    bare = not any(c.isspace() for t in spec.get("added_tokens", ()) for c in t["content"]) and not spec.get("post_processor")
    return bool(plain and drops and bare)


class Counter:
    """A tokenizer of one worker, with the units it has seen."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            self.by_units = cuts_at_spaces(json.load(file))
        self.units: dict[bytes, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        small = []
        for i, text in enumerate(texts):
            if len(text) > chunk:
                out[i] = self.spliced(text, chunk, overlap)
            else:
                small.append(i)
        if not self.by_units:
            for i, found in zip(small, self.tokenizer.encode_batch_fast([texts[i] for i in small], add_special_tokens=False), strict=True):
                out[i] = len(found.ids)
            return out
        split = [_units(texts[i]) for i in small]
        if len(self.units) > UNITS_KEPT:
            self.units.clear()
        fresh = list({u for units in split for u in units if u not in self.units})
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            for unit, found in zip(part, self.tokenizer.encode_batch_fast([u.decode() for u in part], add_special_tokens=False), strict=True):
                self.units[unit] = len(found.ids)
        of = self.units.__getitem__
        for i, units in zip(small, split, strict=True):
            out[i] = sum(map(of, units))
        return out

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a huge text: a chunk at a time, each spliced to what follows it."""
        total, start, skip = 0, 0, 0  # tokens of text[start:] before the offset skip are counted already
        left = self._encoded(text, start, start + chunk)
        while start + chunk < len(text):
            stop, width = start + chunk, overlap
            while width < chunk:
                begin = stop - width
                right = self._encoded(text, begin, begin + chunk)
                cut = _common_boundary(text, left, right, begin, stop, skip)
                if cut is not None:
                    total += int(((left[1] >= skip) & (left[1] < cut)).sum())
                    start, skip, left = begin, cut, right
                    break
                width *= 2
            else:  # no overlap holds a boundary: make the chunk longer
                chunk *= 2
                left = self._encoded(text, start, start + chunk)
        return total + int((left[1] >= skip).sum())

    def _encoded(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of the tokens of text[begin:end], as offsets in the text."""
        found = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2) + begin
        return np.array(found.ids, np.int64), spans[:, 0], spans[:, 1]


def _common_boundary(text: str, left, right, begin: int, stop: int, skip: int) -> int | None:
    """The start of a token of both, after white space, with AGREE equal tokens on each side in the overlap; or None."""
    a_ids, a_from, a_to = left
    b_ids, b_from, b_to = right
    at = np.searchsorted(a_from, begin)
    mine = {(int(f), int(t), int(i)): n for n, (i, f, t) in enumerate(zip(a_ids[at:], a_from[at:], a_to[at:], strict=True), at)}
    hits = [mine.get((int(f), int(t), int(i))) for i, f, t in zip(b_ids, b_from, b_to, strict=True) if f < stop]
    for n in range(AGREE, len(hits) - AGREE + 1):
        run = hits[n - AGREE : n + AGREE]
        if run[0] is None or run != list(range(run[0], run[0] + 2 * AGREE)):
            continue
        cut = int(b_from[n])
        if cut > skip and text[cut - 1].isspace() and cut > int(b_to[n - 1]):
            return cut
    return None


def _units(text: str) -> list[bytes]:
    """Parts between ASCII white space, in UTF-8."""
    return text.encode("utf-8", "replace").split()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    A null text counts as empty and has no tokens; special strings inside a text become their tokens, as the library does
    by default; nothing is added, cut or padded; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = own.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
