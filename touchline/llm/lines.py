"""Line-first cleaning of documents.

Each line of a text is judged on its own: a line without the end of a sentence
or full of marks isn't prose, one of words between separators or of menu words
is navigation, a short one with a stock phrase is boilerplate. Such lines go,
and a document that loses too much of its text with them goes as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.common import prepare, texts

#: Marks that end a sentence, marks that may follow them, symbols, separators.
ENDS, CLOSERS, SYMBOLS, SEPARATORS = ".!?…。！？؟।", "\"'”’»)]", "#*$%&|<>", "|<>»«·•/\\–—-"
#: Words of menus, and phrases of stock lines: lower case.
MENU = frozenset("home menu login logout next previous back top search share print contact about help sitemap archive categories tags more".split())
PHRASES = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript", "released under", "licensed under", "permission is hereby granted", "copyright ©", "subscribe to our", "click here", "lorem ipsum")
#: Words up to which a line can be a menu or stock line.
MENU_WORDS, STOCK_WORDS = 8, 60
#: Shares of a line's words: with runs of marks, lone separators. Share of a text's words that may go.
NOISY, SEPARATED, LOST = 0.2, 0.1, 0.5

_BLANK = r"[\x20\x09-\x0D]"
_WORD_END = rf"[{re.escape(CLOSERS)}]*(?={_BLANK}|\Z)"
_SENTENCE_END = re.compile(rf"[{re.escape(ENDS)}]{_WORD_END}")
_NOISE = re.compile(rf"(?:[!?]{{2,}}|[{re.escape(SYMBOLS)}]{{2,}}){_WORD_END}")
_SEPARATOR = re.compile(rf"(?<![^\x20\x09-\x0D])[{re.escape(SEPARATORS)}]+(?={_BLANK}|\Z)")
_STOCK = re.compile("|".join(map(re.escape, PHRASES)))
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def fails(line: str, n: int) -> str | None:
    """The rule that a line of n words fails; None for prose."""
    if not _SENTENCE_END.search(line) or len(_NOISE.findall(line)) > NOISY * n:
        return "punctuation"
    if len(_SEPARATOR.findall(line)) > max(1, SEPARATED * n):
        return "navigation"
    if n <= STOCK_WORDS:
        low = line.translate(_LOWER)
        if n <= MENU_WORDS and all(w.decode().strip(_EDGES) in MENU for w in low.encode().split()):
            return "navigation"
        if _STOCK.search(low):
            return "boilerplate"
    return None


def cleaned(data: bytes) -> tuple[list[str], int]:
    """The lines that stay, and the number of words of those that go. Lines
    without a word stay."""
    kept, lost = [], 0
    for raw in data.split(b"\n"):
        n, line = len(raw.split()), raw.decode()
        if n and fails(line, n):
            lost += n
        else:
            kept.append(line)
    return kept, lost


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # pairs numbered first, so that three numbers fit one long
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= again
    return int(inside.sum())


def measures(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    solid = data.translate(None, b" \t\n\x0b\x0c\r")
    # code points: bytes that don't continue one
    chars = len(solid) - int(((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80).sum())
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS.encode())), len(lines) - len(set(lines)), repeated_words(words)


def judged(data: bytes, least_words: int = 50, most_repeated: int = 50) -> tuple:
    """The measures, base_failed, kept, lost_words and kept_text of a text."""
    base = measures(data)
    failed = base[0] < least_words or 100 * base[4] > most_repeated * base[0]
    kept, lost = cleaned(data)
    return *base, failed, not failed and lost <= LOST * base[0], lost, "\n".join(kept)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_words", pa.int64()), ("kept_text", pa.string())])


def clean(docs: DataFrame) -> DataFrame:
    """For each row of docs its measures, base_failed, kept, lost_words (of the
    lines that failed a rule) and kept_text (the lines that stay).

    A document fails outright with fewer than 50 words or with over half of
    its words in repeated windows of three, and is rejected by its lines if
    over half of its words go with them. Null texts count as empty: they have
    no words and fail. Very long texts count whole. Repeated rows are rows
    each with equal verdicts; rows without doc_id are judged too. An empty
    table gives no rows. Further columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            columns = list(zip(*found, strict=True)) if found else [()] * (len(SCHEMA) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long, kept_text string")
