"""Language identification by compression: the language whose sample, as a zstandard dictionary, makes a text smallest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import sampled
from .runtime import ready, removed, written

SAMPLE_TEXTS = 400  # different labelled texts that are read for each language, at most
DICTIONARY_BYTES = 1 << 15  # raw content kept for each language
PASSAGE_BYTES = 256  # of each sampled text
PIECE_BYTES = 1 << 11  # whole texts are compressed in pieces of this size, each from the bare dictionary
LEVEL, FINE = 6, 19  # texts with a narrow margin are judged again at the fine level, which finds shorter matches
NARROW = 0.004  # second smallest over smallest, less 1: below this the text is rejected
RESULT = "struct<lang:string,score:double,margin:double,rejected:boolean>"

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _plain(text: str) -> bytes:
    """Lower-case words only: digits, punctuation and symbols say nothing about the language."""
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "  # the ends of words tell much, also in short texts


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass
class Dictionaries:
    """Raw content for each language, in the order of the languages' names."""

    content: dict[str, bytes]

    def compressors(self, level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.content.values():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            out.append(zstandard.ZstdCompressor(dict_data=raw, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def judge(self, plain: bytes, compressors: list[zstandard.ZstdCompressor]) -> tuple[str, float]:
        """The language of the smallest output (of equals, the first by name), and its margin over the second."""
        pieces = [plain[k : k + PIECE_BYTES] for k in range(0, len(plain), PIECE_BYTES)] or [b""]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors]
        names = list(self.content)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], names[k]))
        second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        return names[best], second / sizes[best] - 1


def _passage(plain: bytes) -> bytes:
    """What of a text may become part of a dictionary: its middle."""
    middle = max(0, (len(plain) - PASSAGE_BYTES) // 2)
    return plain[middle : middle + PASSAGE_BYTES]


def _gathered(passages: dict[str, list[bytes]]) -> Dictionaries:
    content = {}
    for lang in sorted(passages):
        room, parts = DICTIONARY_BYTES, []
        for passage in passages[lang]:
            parts.append(passage[:room])
            room -= len(parts[-1])
            if room <= 0:
                break
        content[lang] = b" ".join(parts)
    return Dictionaries(content)


def _passages() -> Column:
    def cut(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([_passage(_plain(t)) if has_letter(t) else None for t in column.to_pylist()], pa.binary())

    return F.arrow_udf(cut, "binary")("text")


def _agrees(halves: tuple[Dictionaries, Dictionaries]) -> Column:
    """Whether the half that a whole text isn't in gives it its own language, or doesn't know that language."""

    def judge(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        compressors = [d.compressors() for d in halves]
        for text, lang, half in columns:
            out = []
            for t, own, h in zip(text.to_pylist(), lang.to_pylist(), half.to_pylist(), strict=True):
                other = halves[1 - h]
                out.append(own not in other.content or other.judge(_plain(t), compressors[1 - h])[0] == own)
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(judge, "boolean")("text", "lang", "half")


def fit(labelled: DataFrame) -> Dictionaries:
    """Dictionaries from (text, lang) rows; rows with a null text or lang, or no letter in the text, are ignored.

    SAMPLE_TEXTS different texts a language are drawn by a hash of the text, all of a language that has fewer; repeated
    rows count once. Two halves then judge each other's whole texts, where these are, and texts whose label the other half
    contradicts are left out of the final dictionaries. Only passages of PASSAGE_BYTES, the middles of the texts, come to
    the driver.
    """
    spark = ready(labelled.sparkSession)
    texts = labelled.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = sampled(texts.select("text", "lang", F.xxhash64("text", F.lit(17)).alias("draw")), "lang", SAMPLE_TEXTS)
    rows = written(rows.withColumn("half", F.shiftrightunsigned("draw", 7).bitwiseAND(F.lit(1)).cast("int")), "labelled-texts")
    drawn = sorted(rows.select("lang", "draw", "half", _passages().alias("passage")).collect(), key=lambda r: (r.draw, r.lang))
    passages: tuple[dict, dict] = ({}, {})
    for r in drawn:
        if r.passage is not None:
            passages[r.half].setdefault(r.lang, []).append(r.passage)
    halves = _gathered(passages[0]), _gathered(passages[1])
    agreed = {(r.lang, r.draw) for r in rows.select("lang", "draw", _agrees(halves).alias("agrees")).where("agrees").collect()}
    removed(spark, rows)
    kept: dict[str, list[bytes]] = {}
    for both in (True, False):  # a language of which nothing agrees keeps all
        for lang in {*passages[0], *passages[1]} - kept.keys():
            own = [r.passage for r in drawn if r.lang == lang and r.passage is not None and (not both or (lang, r.draw) in agreed)]
            if own:
                kept[lang] = own
    return _gathered(kept)


def language(text: Column | str, dictionaries: Dictionaries):
    """A struct column: lang ('und' for null, for a text without letters, or if nothing was learned), score, margin, rejected.

    The score rises from 0 to 1 with the margin. A text is rejected if it is 'und' or its margin is narrow; it still has
    the language that came first. Texts are compressed whole, in pieces.
    """

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors, fine = dictionaries.compressors(), dictionaries.compressors(FINE)
        for column in columns:
            rows = []
            for text in column.to_pylist():
                if not dictionaries.content or not has_letter(text):
                    rows.append(("und", 0.0, 0.0, True))
                    continue
                lang, margin = dictionaries.judge(plain := _plain(text), compressors)
                if margin < NARROW:
                    lang, margin = dictionaries.judge(plain, fine)
                rows.append((lang, 1 - math.exp(-margin / 0.02), margin, margin < NARROW))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "score", "margin", "rejected"])

    return F.arrow_udf(judge, RESULT)(text)


def identified(docs: DataFrame, dictionaries: Dictionaries, into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (see ``language``)."""
    ready(docs.sparkSession)
    return docs.withColumn(into, language("text", dictionaries))
