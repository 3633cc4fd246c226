"""Quality rules from tokeniser fertility: how public vocabularies take a text apart.

Clean text of a language that a vocabulary knows gets few tokens a character,
hardly any byte fallbacks, and tokens as varied as words are. Each language (or
script, where the language is unknown) has bands for the figures of two vocabularies; a text
outside one of them is rejected. Cheap base rules on words and lines come first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkCache, WordEncoder, cached_in_worker, small_batches, text_slices, window_hashes, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Characters a piece (least, most), byte-fallback share (most) and entropy in bits (least, most) under the vocabulary of pieces, and
    characters a token (least, most) under that of words."""

    chars_per_token: tuple[float, float] = (1.2, 8.0)
    byte_share: float = 0.2
    entropy: tuple[float, float] = (3.5, 14.0)
    chars_per_word_token: tuple[float, float] = (1.0, 9.0)


#: Least characters a piece, least entropy and least characters a word token by language, fitted once on the labelled documents of even doc_id
#: that pass the base rules at sf0.1 (1578 of quality 1, 129 of quality 0). The first two are what no clean one is under, rounded down; the last is the
#: hundredth at which 3 x clean documents under it + poor ones over it are fewest. No labelled row is unclean on the high side or by byte
#: fallbacks, so those limits are not fitted.
FITTED = {"en": (1.85, 5.5, 2.18), "fr": (1.71, 5.7, 1.86), "de": (2.04, 5.7, 2.02), "es": (1.80, 5.8, 1.79)}


@dataclass(frozen=True)
class Bands:
    """Bands by language, else by the script of most letters, else ``other``."""

    languages: dict[str, Band] = field(default_factory=lambda: {x: Band((chars, 8.0), 0.1, (bits, 14.0), (words, 9.0)) for x, (chars, bits, words) in FITTED.items()})
    scripts: dict[str, Band] = field(default_factory=lambda: {"latin": Band(), "greek_cyrillic": Band((1.0, 8.0), chars_per_word_token=(0.8, 9.0)), "cjk": Band((0.3, 4.0), 0.9, (3.5, 16.0), (0.2, 4.0))})
    other: Band = Band((0.25, 8.0), 1.0, (3.0, 16.0), (0.2, 9.0))

    def of(self, lang: str | None, script: str) -> Band:
        return self.languages.get(lang or "") or self.scripts.get(script, self.other)


def script_of(text_bytes: np.ndarray) -> str:
    """Script of most letters, from the lead bytes of UTF-8 (Latin to U+024F, Greek and Cyrillic to U+04FF, CJK from U+3000)."""
    latin = int(np.count_nonzero(_LATIN[text_bytes]))
    greek = int(np.count_nonzero((text_bytes >= 0xCD) & (text_bytes <= 0xD3)))
    cjk = int(np.count_nonzero((text_bytes >= 0xE3) & (text_bytes <= 0xED)))
    top = max(latin, greek, cjk)
    return "other" if not top else "latin" if top == latin else "greek_cyrillic" if top == greek else "cjk"


_LATIN = np.zeros(256, bool)
_LATIN[65:91] = _LATIN[97:123] = _LATIN[0xC3:0xCA] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


class PieceCounter(ChunkCache):
    """Pieces of each word under a sentencepiece model, words apart."""

    def __init__(self, model: str):
        super().__init__()
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.is_byte = np.array([self.sp.is_byte(i) or self.sp.is_unknown(i) for i in range(self.sp.get_piece_size())])

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        return self.sp.encode(chunks, num_threads=1)


@cached_in_worker
def vocabularies(pieces: str, words: str) -> tuple[PieceCounter, WordEncoder]:
    """Both vocabularies of a worker process."""
    return PieceCounter(pieces), WordEncoder(words, plain=True)


def entropy(ids: np.ndarray) -> float:
    """Bits a token of the text's own token frequencies; 0 for none."""
    if not len(ids):
        return 0.0
    ids = np.sort(ids)
    n = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
    p = n / len(ids)
    return float(-(p * np.log2(p)).sum())


def _lines_again(data: np.ndarray, spans: tuple[np.ndarray, np.ndarray]) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.tobytes().split(b"\n")
    worded = [x for x in lines if x.split()]
    return len(worded) - len(set(worded))


def base_rows(column: pa.Array):
    """For each row (row number, word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, bytes)."""
    for row, off, data in text_slices(column):
        starts, ends, bounds = word_spans(off, data)
        words = word_hashes(data, starts, ends)
        triples = window_hashes(words, 3)
        # code points: bytes that don't continue one; words hold all bytes that aren't white space
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        symbol = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        chars = np.concatenate(([0], np.cumsum(lead[ends] - lead[starts]))) if len(starts) else np.zeros(1, np.int64)
        for i in range(len(off) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            again = 0
            if b - a >= 4:
                t = triples[a : b - 2]
                order = np.argsort(t, kind="stable")
                s = t[order]
                same = s[1:] == s[:-1]
                if same.any():
                    twice = np.zeros(len(t), bool)
                    twice[order[1:][same]] = twice[order[:-1][same]] = True
                    in_window = np.zeros(b - a, bool)
                    for j in range(3):
                        in_window[j : j + len(t)] |= twice
                    again = int(in_window.sum())
            own = data[off[i] : off[i + 1]]
            yield row + i, int(chars[b] - chars[a]), b - a, int(symbol[off[i + 1]] - symbol[off[i]]), _lines_again(own, (starts, ends)) if b > a else 0, again, own


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double, chars_per_word_token double, script string"


def quality(docs: DataFrame, pieces: str, words: str, bands: Bands | None = None, keep_columns: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Base counts, fertility figures and the verdict for each row of ``text`` (and ``lang``, if there).

    base_failed: under 50 words, or over half of the words in three-word windows
    that the text has twice. kept: base passed and all figures inside the
    band of the language or script. Figures are over the text's words one by one: under the sentencepiece
    model ``pieces``, characters a piece, the share of pieces that are byte fallbacks or unknown and
    the entropy of the pieces; under ``words``, a file of the tokenizers library, characters a token. A null text is empty: all counts 0, figures 0,
    not kept. A null or unknown language goes by script. ``keep_columns`` pass
    through (``with_text``: the text too); others, of whatever names, aren't read. An empty table stays empty."""
    bands = bands or Bands()
    small_batches(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    keep_columns = tuple(c for c in keep_columns if not (with_text and c == "text"))
    seen = docs.select(*keep_columns, F.col("text").cast("string").alias("_text"), lang.alias("_lang"))
    kept_schema = seen.select(*keep_columns).schema
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4 + [pa.string()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, encoder = vocabularies(pieces, words)
        for batch in batches:
            text, lang = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
            cols: list[list] = [[] for _ in names]
            base, tokens = base_rows(text), encoder.rows(text)
            for _, ids, off in counter.slices(text):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    row, chars, n_words, symbols, lines, again, own = next(base)
                    n, m = b - a, len(next(tokens))
                    script = script_of(own)
                    figures = (chars / n if n else 0.0, float(counter.is_byte[ids[a:b]].sum()) / n if n else 0.0, entropy(ids[a:b]), chars / m if m else 0.0)
                    band = bands.of(lang[row], script)
                    failed = n_words < 50 or 100 * again > 50 * n_words
                    kept = not failed and band.chars_per_token[0] <= figures[0] <= band.chars_per_token[1] and figures[1] <= band.byte_share and band.entropy[0] <= figures[2] <= band.entropy[1] and band.chars_per_word_token[0] <= figures[3] <= band.chars_per_word_token[1]
                    for c, v in zip(cols, (n_words, chars, symbols, lines, again, failed, kept, *figures, script), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 2)], *[text] * with_text, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*batch.schema.names[:-2], *["text"] * with_text, *names])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept_schema], *["text string"] * with_text, _OUT])
    return seen.mapInArrow(judge, fields)
